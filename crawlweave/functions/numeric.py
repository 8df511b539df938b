"""Scores, priorities and error measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed-point factor of priorities; the priorities of an empty queue and of a removed entry; score before any fit.
PRIORITY_SCALE = 10_000
EMPTY_PRIORITY = -150_000_000
REMOVED_PRIORITY = 150_000_000
UNFIT_SCORE = 0.05


def score_to_priority(score: Column) -> Column:
    """Fixed point: times 10000, truncated toward zero."""
    return (score * PRIORITY_SCALE).cast("int")


def priority_to_score(priority: Column) -> Column:
    return priority / F.lit(float(PRIORITY_SCALE))


def coarse_priority(score: Column, levels: int = 20) -> Column:
    """Few priority levels for queues that keep a list per level."""
    return (score * levels).cast("int")


def softmax_weight(value: Column, over, temperature: float = 1.0) -> Column:
    """exp(value / t) shifted by the window's maximum, so that nothing overflows; divided by its sum it is the softmax."""
    z = value / F.lit(float(temperature))
    return F.exp(z - F.max(z).over(over))


def decreasing_priority(position: Column, block: int = 5) -> Column:
    """Blocks of `block` links get 0, -1, -2, ... (position counts from 0)."""
    return (-F.floor(position / block)).cast("int")


def reschedule_interval(entries: Column, per_second: float = 30_000.0, share: float = 0.33, page_seconds: float = 0.1) -> Column:
    """Responses between two re-scorings, so that re-scoring takes `share` of the time."""
    return (entries / per_second / (share / (1 - share)) / page_seconds).cast("int")


def batch_size(queues: Column) -> Column:
    """Requests drawn at once: a thousandth of the queues, from 1 to 1000."""
    return F.least(F.lit(1000), F.greatest(F.lit(1), F.floor(queues / 1000).cast("int")))


def response_ok(status: Column, text: Column) -> Column:
    return (status == 200) & text.isNotNull()


def reward_delta(source: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), target - source)


def cross_entropy(truth: Column, guess: Column, eps: float = 1e-8) -> Column:
    return -(truth * F.log(guess + eps) + (1 - truth) * F.log(1 - guess + eps))


def squared_error(truth: Column, guess: Column) -> Column:
    return (guess - truth) * (guess - truth)


def top2_margin(scores: Column) -> Column:
    """Largest minus second largest of an array; null for fewer than two values."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(scores) >= 2, F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def clip0(guess: Column) -> Column:
    return F.greatest(guess, F.lit(0.0))


def chunk(position: Column, size: int = 4096) -> Column:
    return F.floor(position / size).cast("long")


def sparse_bytes(stored: Column, rows: Column) -> Column:
    """Memory of a sparse row matrix: 12 bytes a stored value, 4 a row pointer."""
    return stored * 12 + (rows + 1) * 4
