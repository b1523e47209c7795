import random

import pytest
from pyspark.sql import functions as F

from koengine.llm import mixing, residue, split, tokens

TOKENIZERS = tokens.TOKENIZER_DIR


# ---- splitting


def test_split_round_trip(spark):
    rng = random.Random(3)
    bits = ["word ", "a longer sentence ends here. ", "line\n", "\r\n", "\n\n", "日本語の文。", "x" * 37, "é̂", "; ", "😀"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 120))), rng.choice(["P", "Q", None, "none"]), "clash") for i in range(80)]
    rows += [(900, None, "P", ""), (901, "", "P", ""), (902, "y" * 5000, "P", ""), (902, "y" * 5000, "P", "")]
    df = spark.createDataFrame(rows, "id long, text string, kind string, piece string")
    lim = spark.createDataFrame([("P", 100, 10), ("Q", 60, 0), ("Unknown", 80, 79), (None, 5, 1)], "block_type string, max_chars int, overlap_chars int")
    most = {"P": (100, 10), "Q": (60, 0), None: (80, 79)}
    got = {}
    for r in split.split_oversized(df, lim, key="id", text="text", kind="kind").collect():
        got.setdefault(r["id"], []).append(r)
    for i, t, k, _ in rows:
        limit = most.get(k)
        if not t or limit is None or len(t) <= limit[0]:
            assert i not in got
            continue
        pieces = sorted(got[i], key=lambda r: r["piece_no"])
        end = 0
        for n, p in enumerate(pieces):
            assert len(p["piece"]) == p["n_chars"] <= limit[0] and t[p["start_at"] : p["start_at"] + p["n_chars"]] == p["piece"]
            assert p["start_at"] == (0 if n == 0 else max(0, end - limit[1]))
            end = p["start_at"] + p["n_chars"]
        assert end == len(t)


def test_split_prefers_strong_boundaries(spark):
    df = spark.createDataFrame([(1, "one two three. four five\n\nsix seven eight nine ten")], "id long, text string").withColumn("k", F.lit("P"))
    lim = spark.createDataFrame([("P", 30, 0)], "block_type string, max_chars int, overlap_chars int")
    assert [r["piece"] for r in split.split_oversized(df, lim, key="id", text="text", kind="k").orderBy("piece_no").collect()] == ["one two three. four five\n\n", "six seven eight nine ten"]


def test_split_uses_a_boundary_anywhere_before_it_cuts_a_word(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb " + "c" * 25)], "id long, text string").withColumn("k", F.lit("P"))
    lim = spark.createDataFrame([("P", 30, 0)], "block_type string, max_chars int, overlap_chars int")
    assert [r["piece"] for r in split.split_oversized(df, lim, key="id", text="text", kind="k").orderBy("piece_no").collect()] == ["aaaa bbbb ", "c" * 25]


# ---- encoding


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(open(f"{TOKENIZERS}/{tokens.VOCABULARY}", "rb").read())


def test_ids_equal_the_public_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/{tokens.VOCABULARY}")
    t.encode_special_tokens = True
    rng = random.Random(1)
    bits = ["a", "the", "ing", "é", "日本", "😀", " ", "  ", "\n", "\t", "1", "23", "!", "...", "<|endoftext|>", "'s", "'LL", "ß", "́", "ل", "x" * 30, "aaaa", "\x00", "‍", "-", "_"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert encoder.ids(s) == t.encode(s, add_special_tokens=False).ids


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "hello world")], "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("k", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, key="doc_id", text="text").collect()}
    assert got == {1: [31373, 995], 2: [], 3: [], 4: [31373, 995]}
    assert tokens.encode_corpus(df.limit(0), key="doc_id", text="text").count() == 0


# ---- mixing


def test_plan():
    block, slots, need, line = mixing.plan_mixture({"a": 1000, "b": 100, "z": 50}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.2, 1), "n": (None, 1)}, 10)
    assert slots * 0.5 * block <= 300 and need["b"] == 3 and line[-1] == ("b", 1.0)
    assert mixing.plan_mixture({}, {"a": (1.0, 1)}, 10)[1] == 0


def test_mixture_keeps_shares_and_caps(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaaab") if i else "b", rng.randint(1, 60)) for i in range(4000)] + [(9001, "lost", 5), (9002, None, 5)]
    sized = spark.createDataFrame([r for r in rows if r[1]], "key long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(sized, targets, block_tokens=64)
    got = mix.collect()
    total = sum(r["n_tokens"] for r in got)
    for s, share, cap in (("a", 0.6, 1), ("b", 0.4, 3)):
        assert abs(sum(r["n_tokens"] for r in got if r["source"] == s) / total - share) < 0.01
        uses = {}
        for r in got:
            if r["source"] == s:
                uses[r["key"]] = uses.get(r["key"], 0) + 1
        assert max(uses.values()) <= cap
    assert len({(r["key"], r["copy_no"]) for r in got}) == len(got)
    # shares hold along the sequence, too
    half = [r for r in got if r["slot"] < max(x["slot"] for x in got) / 2]
    assert abs(sum(r["n_tokens"] for r in half if r["source"] == "a") / sum(r["n_tokens"] for r in half) - 0.6) < 0.03
    # as large as the caps allow, but for a few slots
    assert sum(r["n_tokens"] for r in got if r["source"] == "b") > 0.9 * min(3 * sum(r[2] for r in rows if r[1] == "b"), sum(r[2] for r in rows if r[1] == "a") / 0.6 * 0.4)
    rep = {r["source"]: r for r in mixing.share_report(mix, targets).collect()}
    assert rep["none"]["tokens"] == 0 and rep["b"]["most_uses"] <= 3


def test_mixture_of_nothing(spark):
    sized = spark.createDataFrame([], "key long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(sized, targets).count() == 0


# ---- residue


BAD = [
    "# {{ title }}\n\nReal words follow here and there.", "Dear ${name}, the claim is ready.", "Owner: [Your owner], due [TODO: add date]", "<insert title here> and more", "Contact <%= who %> first.", "Hello __NAME__!",
    "Lorem ipsum dolor sit amet.\nSed magna aliqua commodo velit.", "404 Not Found", "Home\nMenu\n\n503 Service Unavailable\n\nPlease try again in a few minutes.", '{"status":500,"message":"Server error"}',
    "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "この頁を見るには JavaScript を有効にしてください。", "Your text goes here.", "blah blah blah blah", "Checking your browser before access… this may take 5 seconds.",
]
GOOD = [
    "The renderer replaces `{{name}}` with the value.", "```\nexport A=${B}\n```\nSet it before you call.", "Crawler rule 7 drops pages whose only line is \"Page not found\", because they carry nothing.",
    "Without JavaScript the graph view falls back to a static table, which the crawler can read.", "Templates use <%= team %> for values and <% if %> for branches; both are described below.", "A plain note about the import batch and its lease.",
    "ok, thanks (12)", "fn f(a: &Koid) -> Option<Claim> {", "A generic type such as Map<Key, Value> is printed.", None, "", "   ",
]


def test_residue(spark):
    rows = [(i, t, f"h{i % 4}") for i, t in enumerate(BAD)] + [(1000 + i, t, None) for i, t in enumerate(GOOD)] + [(1, BAD[1], "h1")]
    df = spark.createDataFrame(rows, "id long, text string, host string").withColumn("key", F.lit("clash")).withColumn("lines", F.lit(1))
    got = {r["id"] for r in residue.find_residue(df, key="id", text="text", host="host").collect()}
    assert {i for i in got if i >= 1000} == set()
    assert got == set(range(len(BAD)))
    assert residue.find_residue(df.limit(0), key="id", text="text", host="host").count() == 0


def test_residue_of_words_in_no_phrase_list(spark):
    bad = [
        "upstream connect error or disconnect/reset before headers", "Cannot GET /api/v1/items", "Lorem doppelt ipsum gebucht dolor amet.", "Scripts are switched off: allow scripts or cookies.", "HTTP 504", "Captcha required",
        "Zugriff verweigert!", "x" * 5000 + "\n404 Not Found\n" + "Page not found. " * 300,
    ]
    good = ["The scripts of the nightly run write one line for each lease that was renewed, and the browser shows them in a table beside the graph.", "Our error budget for the quarter is spent, so the team pauses releases until the platform group has met."]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(bad[:-1] + good)], "id long, text string, host string")
    got = {r["id"] for r in residue.find_residue(df, key="id", text="text", host="host").collect()}
    assert got == set(range(len(bad) - 1))


def test_residue_learns_from_pages_beside_known_ones(spark):
    """A line without any seed word is evidence once it stands beside known ones on several hosts."""
    line = "Wombat tripped over quux."
    rows = [(i, f"503 Service Unavailable\n{line}", f"h{i}") for i in range(12)]
    rows += [(100 + i, f"The planner of run {i} wrote a note about topic {i * 7} and error handling in the {w} module, which the desk reviews.", f"h{i % 9}") for i, w in enumerate(["lease", "graph", "scan", "merge", "trace"] * 12)]
    alone = [(500, line, "h3"), (501, "A plain remark stands here.", "h4")]
    find = lambda r: {x["id"] for x in residue.find_residue(spark.createDataFrame(r, "id long, text string, host string"), key="id", text="text", host="host").collect()}
    assert find(rows + alone) == {*range(12), 500}
    assert find(rows[12:] + alone) == set()


def test_residue_subtracts_recurrent_lines(spark):
    nav = "Shared navigation bar of the whole archive"
    rows = [(i, f"{nav}\nA sentence about topic number {i} that stands by itself.", f"h{i % 5}") for i in range(20)] + [(99, f"{nav}\nPlease enable JavaScript to view this page.", "h0")]
    df = spark.createDataFrame(rows, "id long, text string, host string")
    assert [r["id"] for r in residue.find_residue(df, key="id", text="text", host="host").collect()] == [99]


def test_residue_counts_the_words_of_every_document(spark):
    """What 30,000 of 40,000 ordinary documents say is no evidence; a draw of 20,000 by the hash of the text (as once) holds none of these copies."""
    line = "Wombat tripped over quux."
    rows = [(i, f"503 Service Unavailable\nThe server is temporarily unavailable, please try again later.\n{line}", f"h{i}") for i in range(12)] + [(500, line, "h3")]
    many = spark.range(1000, 41_000).select("id", F.when(F.col("id") < 31_000, "The wombat of the team tripped over a quux in garden 11.").otherwise("A plain note about the import batch.").alias("text"), F.concat(F.lit("h"), F.col("id") % 9).alias("host"))
    df = many.unionByName(spark.createDataFrame(rows, "id long, text string, host string"))
    assert {r["id"] for r in residue.find_residue(df, key="id", text="text", host="host").collect()} == set(range(12))
