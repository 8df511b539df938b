import collections

from crawlweave.llm import lines as L
from crawlweave.llm.pagetree import line_text

ROWS = [(i, " Site.Test " if i % 2 else "site.test", f"<p>Share this {i}</p>\nown words of page {'abcdefgh'[i]}\n\n<br>\n&copy; 20{i:02d} Site") for i in range(8)]


def brute(rows, n):
    seen, at = collections.defaultdict(set), []
    for i, dom, raw in rows:
        if i is None or not dom or not dom.strip() or not raw:
            continue
        for no, line in enumerate(raw.split("\n"), 1):
            t = line_text(line)
            if t:
                k = (dom.strip().lower(), L.line_key(t))
                seen[k].add(i)
                at.append((i, no, k))
    return sorted({(i, no) for i, no, k in at if len(seen[k]) >= n})


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, domain string, raw_content string")


def found(df, **k):
    return sorted((r.item_id, r.line_no) for r in L.repeated_lines(df, **k).collect())


def test_repeated_lines_match_brute_force(spark):
    rows = [*ROWS, (20, None, ROWS[0][2]), (21, "other.test", ROWS[0][2]), (22, "site.test", None), (23, "site.test", ""), (24, " ", "x"), (None, "site.test", "x"), ROWS[0], ROWS[0]]
    assert found(items(spark, rows)) == brute(rows, 5) and (0, 1) in brute(rows, 5) and (0, 5) in brute(rows, 5)


def test_a_line_repeated_in_one_document_is_one_document(spark):
    rows = [(1, "s", "same\n" * 9), (2, "s", "same")]
    assert found(items(spark, rows), min_docs=2) == brute(rows, 2) and found(items(spark, rows), min_docs=3) == []


def test_share_of_documents(spark):
    assert found(items(spark, ROWS), min_docs=2, min_share=0.9) == brute(ROWS, 8)
    assert found(items(spark, [*ROWS, *[(50 + k, "site.test", f"words {'xyzuvw'[k % 6]}{k}") for k in range(6)]]), min_docs=2, min_share=0.95) == []


def test_stripping_rebuilds_every_document(spark):
    rows = [*ROWS, (22, "site.test", None), (23, None, "a\nb"), (24, "site.test", "")]
    got = {r.item_id: (r.removed, r.text) for r in L.strip_repeated_lines(items(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[0] == (2, "own words of page a\n\n<br>") and got[22] == (0, None) and got[23] == (0, "a\nb") and got[24] == (0, "")


def test_empty_table_clashing_columns_and_long_text(spark):
    assert found(items(spark, [])) == []
    long = "\n".join(f"line {'ab'[k % 2]} of many" for k in range(20_000))
    df = items(spark, [(k, "s", long) for k in range(5)])
    for c in ("site", "line", "line_no", "raw", "docs", "gone", "removed", "text"):
        df = df.withColumn(c, df.item_id)
    assert L.repeated_lines(df).count() == 100_000 and L.strip_repeated_lines(df).where("removed = 20000").count() == 5


def test_line_text_rules():
    assert line_text("<a href='x'>a&nbsp;&amp; <b> b</b> </a>\r") == "a & b" and line_text("<br>") == ""
    assert L.line_key("On 12-05 At 7 ÄÖ") == "on 0-0 at 0 äö"
