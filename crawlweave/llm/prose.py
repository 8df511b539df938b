"""Words, languages and sentences, as the page operators count them."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")

# Function words by language.
FUNCTION = {
    "en": "the of and a an to in is that for it with as on at by this from but not are be has have we you your our their or which when if can yet because was were will do does don’t don't every before after since without both during once all most",
    "de": "der die das und den dem des ein eine einen einem einer ist nicht mit für auf von zu im in an als auch wenn nach bei aus seit dem wer ob oder aber wie nur noch um zum zur ohne während vor über jeden jede alle beiden",
    "fr": "le la les de des du un une et est dans que qui pour pas sur par avec au aux ce cette ou où mais si comme selon sans après dès là même pendant depuis déjà on a son sa ses plus très fin",
    "es": "el la los las de del un una y en que por para con no se su al como más pero si sin según desde aunque cuando o este esta ya es aquel así cada después ambos el",
    "ru": "и в на не что с по как для то из к у за от о но а если без после до же или это его ее все всех наш так там уже при во",
    "pt": "o a os as de do da dos das um uma e em que por para com não se ao como mais mas sem segundo desde embora quando ou este esta já é aquele assim cada depois ambos são está",
}
SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION.items()}
STOP = frozenset().union(*SETS.values())
LANGS: dict[str, tuple[str, ...]] = {w: tuple(n for n, own in SETS.items() if w in own) for w in STOP}
LISTED = re.compile(r"[|,;/•·»#]")
STOPS = re.compile(r"[.!?…]+(?=[\s»”\"')\]]|$)")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def language(text: str) -> str:
    """The language whose function words are the most; `und` without any."""
    hits: dict[str, int] = {}
    for w, n in Counter(filter(LANGS.__contains__, text.lower().split())).items():
        for lang in LANGS[w]:
            hits[lang] = hits.get(lang, 0) + n
    return max(hits.items(), key=lambda kv: (kv[1], kv[0]))[0] if hits else "und"


def parts(low: str) -> list[tuple[str, list[str]]]:
    """A lower-cased text cut at closing marks, with the words of each part; the last part is not closed. No word spans a mark."""
    return [(part, WORD.findall(part)) for part in STOPS.split(low)]


def full(cut: list[tuple[str, list[str]]], own: frozenset[str] = STOP) -> int:
    """Full sentences among `parts`: five words or more up to a closing mark, with function words or without the separators of a list."""
    n = 0
    for part, ws in cut[:-1]:
        if len(ws) >= 5 and (sum(map(own.__contains__, ws)) * 8 >= len(ws) or len(LISTED.findall(part)) * 6 < len(ws)):
            n += 1
    return n


def sentences(text: str, own: frozenset[str] = STOP) -> int:
    """Full sentences of a text."""
    return full(parts(text.lower()), own)
