import random

from koengine.llm import ocr

HEADER = "report on the planner and its many rules"


def _misread(w: str, at: int) -> str:
    return w[:at] + "q" + w[at + 1 :]


def _pages(spark, pages=12):
    """A header that every page misreads differently, below two lines that come first in the alphabet."""
    rng = random.Random(4)
    word = lambda first: first + "".join(rng.choice("abcdefghijklmnop") for _ in range(18))
    rows = []
    for p in range(pages):
        lines = [word("a"), word("b"), _misread(HEADER, 3 * p + 1), *(word("c") for _ in range(8))]
        rows.append(("d1", p, f"p{p:02}", "\n".join(lines)))
    return spark.createDataFrame(rows, "document_id string, page int, page_id string, text string")


def test_header_misread_on_every_page_is_furniture(spark):
    lines = ocr.page_lines(_pages(spark))
    want = {(f"p{p:02}", 3) for p in range(12)}
    assert {(r["page_id"], r["line_no"]) for r in ocr.furniture(lines).where("running").collect()} == want


def test_shared_parts_lose_no_pair(spark):
    rng = random.Random(9)
    keys = set()
    for n in [6, 7, 9, 14, 15, 19, 20, 33, 80] * 3:
        base = "".join(rng.choice("abcde") for _ in range(n))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(2, n // 5) + 1)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice(([], [rng.choice("abcde")], [w[i], rng.choice("abcde")]))
            keys.add("".join(w)[:80])
    keys = sorted(k for k in keys if len(k) >= 6)
    df = spark.createDataFrame([("d", "t", k) for k in keys], "document_id string, slot string, key string")
    every = {(r["key"], r["anchor"]) for r in ocr.alike_keys(df).collect()}
    assert {(r["key"], r["anchor"]) for r in ocr.alike_keys(df, dense=0).collect()} == every
    assert len(every) > len(keys)
