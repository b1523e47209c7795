"""Noise in text from scanned pages: furniture, page numbers, broken words, misread words.

* Lines near a page's edges are compared with their document's most frequent edge lines; line pairs
  alike on several pages are furniture. Page numbers are recognised by their form.
* Words are counted over the whole corpus. Each form that a much commoner word resembles gets
  correction candidates through an inverted join on character bigrams; gradient-boosted trees rank
  the pairs by shape, frequency and confidence, and a form is misread if its best candidate wins.
* A second set of boosted trees looks at a line and the next body line (of the next page, if need
  be) and says whether the word at the break goes on and loses its hyphen.
* :func:`repair` applies all of it and gives continuous paragraphs.

The classifiers are fitted on at most ``TRAIN_WORDS`` of the corpus's own commonest words, split
and corrupted at random by a fixed seed; counts, candidates and decisions cover all data.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from koengine.llm.boost import BoostedTrees
from koengine.llm.names import edits
from koengine.runtime import materialize, ship_code

TRAIN_WORDS = 3000
#: Edge lines of a document up to which all are compared with all; beyond, an exact join on shared parts is cheaper.
DENSE_KEYS = 2_000
HYPHENS = r"\-\x{AD}\x{2010}\x{2011}\x{AC}"
SPECKS = r"[·^~|•¦'`´]+"

# Glyphs that scanners take for one another (print, reading).
CONFUSIONS = (
    ("o", "0"), ("l", "1"), ("i", "!"), ("s", "5"), ("b", "6"), ("g", "9"), ("a", "@"), ("e", "c"), ("h", "b"), ("t", "f"), ("d", "cl"), ("w", "vv"), ("m", "rn"), ("rn", "m"),
    ("u", "ii"), ("n", "ii"), ("nn", "im"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("li", "h"), ("cl", "d"), ("i", "l"), ("l", "i"), ("i", "1"), ("o", "c"), ("c", "e"), ("v", "y"), ("B", "8"), ("z", "2"), ("ri", "n"), ("S", "5"), ("O", "0"), ("I", "l"), ("q", "g"), ("0", "O"), ("1", "l"),
)

_ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUM = r"[0-9lIOo]{1,5}"
#: A line that is nothing but a page number.
PAGE_NUMBER = (
    r"(?i)^\W*(?:(?:p(?:age|agc|@ge|a9e)?\.?|pg\.?|seite|s\.|blatt|folio)\W{0,3})?(?:" + _NUM + r"|(?=[ivxlcdm])" + _ROMAN + r")(?:\W{0,3}(?:of|0f|von|/|de)\W{0,3}" + _NUM + r")?[^\w.]*$"
)
#: A page number within a line of other text.
PAGE_INSIDE = r"(?i)(?:\b(?:page|p\.|seite|pg\.?)\W{0,3}" + _NUM + r"\b|[|—–\-·•]\s*" + _NUM + r"\s*$|^\s*" + _NUM + r"\s*[|—–\-·•]|\b" + _NUM + r"\s*/\s*" + _NUM + r"\s*$|\s{2,}" + _NUM + r"$|^" + _NUM + r"\s{2,})"


_ALIKE = str.maketrans({"0": "o", "1": "l", "!": "l", "i": "l", "5": "s", "6": "h", "b": "h", "9": "g", "@": "a", "e": "c", "t": "f", "8": "B", "u": "n"})


_ALIKE_WIDE = str.maketrans({"o": "c", "y": "v", "q": "g", "2": "z", "B": "h", "S": "s", "O": "c", "I": "l"})


def letters(w: str) -> str:
    """A word with its ligatures spelled out."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        w = w.replace(a, b)
    return w


def fold_shape(w: str, pairs: bool = True) -> str:
    """A word with glyphs (and, if wanted, pairs of glyphs) that look alike made one."""
    w = letters(w)
    if pairs:
        for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("im", "nn")):
            w = w.replace(a, b)
    return w.translate(_ALIKE)


def shapes(w: str) -> tuple[str, str, str]:
    """A word's shape with pairs of glyphs folded, without, and with rarer look-alikes folded too."""
    return fold_shape(w), fold_shape(w, False), fold_shape(w.replace("ri", "n"), False).translate(_ALIKE_WIDE)


def shape_edits(w: str, c: str) -> int:
    return min(edits(a, b, 3) for a, b in zip(shapes(w), shapes(c)))


def pair_features(w: str, c: str, nw: float, nc: float, conf: float) -> list[float]:
    d = edits(w, c, 3)
    s = shape_edits(w, c)
    gw, gc = {w[i : i + 2] for i in range(len(w) - 1)}, {c[i : i + 2] for i in range(len(c) - 1)}
    odd = len(re.findall(r"[^a-zA-Z]", w))
    return [float(np.log((nc + 0.5) / (nw + 0.5))), float(d), float(s), float(len(w)), float(odd), len(gw & gc) / max(1, len(gw | gc)), float(w[:1] == c[:1]), float(w[-1:] == c[-1:]), conf, float(len(w) - len(c))]


def corrupt(w: str, rng: random.Random) -> str:
    ways = [(a, b, m.start()) for a, b in CONFUSIONS for m in re.finditer(re.escape(a), w)]
    if not ways:
        return w
    a, b, i = rng.choice(ways)
    return w[:i] + b + w[i + len(a) :]


def fit_reader(common: list[tuple[str, int]], confs: tuple[list[float], list[float]], seed: int = 5) -> BoostedTrees:
    """Ranks (form, candidate) pairs: 1 if the form is a misreading of the candidate."""
    rng = random.Random(seed)
    # words that make up a fair share of the text; the tail holds the misreadings themselves
    least = sum(n for _, n in common) / 4_000
    words = [(w, n) for w, n in common[:TRAIN_WORDS] if n >= least and re.fullmatch(r"[a-z]{2,}", w)]
    # nor may a form teach that is a far commoner word's look-alike
    twins: dict[tuple[int, str], int] = {}
    for w, n in words:
        for k in enumerate(shapes(w)):
            twins[k] = max(n, twins.get(k, 0))
    words = [(w, n) for w, n in words if all(twins[k] < 20 * n for k in enumerate(shapes(w)))]
    known = {w for w, _ in words}
    x, y = [], []
    low, high = confs[0] or [60.0], confs[1] or [92.0]
    for w, n in words * max(1, 3000 // max(1, len(words))):
        v = corrupt(w, rng)
        if v != w and v not in known and len(w) > 2:
            x.append(pair_features(v, w, max(1.0, n * 10 ** rng.uniform(-4.5, -1.2)), n, rng.choice(low if rng.random() < 0.6 else high)))
            y.append(1)
        # as rare, but changed where no scanner errs: another word, not a misreading
        i = rng.randrange(len(w))
        v = w[:i] + rng.choice("kpqxzrjmwy") + w[i + rng.randrange(2) :]
        if v not in known and v != w and shape_edits(v, w):
            x.append(pair_features(v, w, max(1.0, n * 10 ** rng.uniform(-4.5, -1.2)), n, rng.choice(high if rng.random() < 0.7 else low)))
            y.append(0)
    by_len: dict[int, list] = {}
    for w, n in words:
        by_len.setdefault(len(w), []).append((w, n))
    for w, n in words:  # common words that resemble commoner ones
        near = [(c, m) for k in (-1, 0, 1) for c, m in by_len.get(len(w) + k, []) if m > n and edits(w, c) <= 2]
        for c, m in near[:8]:
            x.append(pair_features(w, c, n, m, rng.choice(high)))
            y.append(0)
    if not x or len(set(y)) < 2:
        return BoostedTrees(rounds=0)
    return BoostedTrees().fit(np.array(x), np.array(y))


def join_features(left: int, right: int, joined: int, compound: int, opens: int, soft: bool) -> list[float]:
    """Corpus counts of the two parts, the joined word, the hyphenated compound, compounds that open like it; soft sign."""
    lg = lambda v: float(np.log1p(v))
    return [lg(left), lg(right), lg(joined), lg(compound), lg(opens), float(soft), lg(joined) - lg(compound)]


def fit_joiner(words: dict[str, int], compounds: dict[str, int], seed: int = 6) -> BoostedTrees:
    """1 if a word broken at a line's end loses its hyphen."""
    rng = random.Random(seed)
    opens: dict[str, int] = {}
    for c, n in compounds.items():
        opens[c.split("-")[0]] = opens.get(c.split("-")[0], 0) + n
    x, y = [], []
    get = lambda w: words.get(w, 0)
    for w, n in list(words.items())[:TRAIN_WORDS]:
        if len(w) < 4 or n < 2 or not w.isalpha():
            continue
        for _ in range(2):
            i = rng.randrange(2, len(w) - 1)
            a, b = w[:i], w[i:]
            j = 0 if rng.random() < 0.08 else n  # now and then a part is misread
            x.append(join_features(get(a), get(b) if j else 0, j, compounds.get(f"{a}-{b}", 0), opens.get(a, 0), rng.random() < 0.5))
            y.append(1)
    for c, n in list(compounds.items())[:TRAIN_WORDS]:
        a, b = c.split("-", 1)
        for _ in range(4):
            miss = rng.random() < 0.15
            x.append(join_features(get(a), 0 if miss else get(b.split("-")[0]), get(a + b), 0 if miss else n, opens.get(a, 0), False))
            y.append(0)
    if not x or len(set(y)) < 2:
        return BoostedTrees(rounds=0)
    return BoostedTrees().fit(np.array(x), np.array(y))


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, page_id, line_no, line, place, back) of every line that is not blank; repeated page ids count once.

    ``place`` and ``back`` count the page's lines that are not blank from the top and the bottom.
    """
    one = pages.where("page_id IS NOT NULL AND text IS NOT NULL").groupBy("page_id").agg(F.max(F.struct("text", "document_id", "page")).alias("x")).select("page_id", "x.*")
    numbered = F.transform(F.split("text", "\n"), lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("line")))
    full = F.filter(numbered, lambda s: s["line"].rlike(r"\S"))
    cut = one.select("document_id", "page", "page_id", full.alias("ls"))
    cut = cut.select("document_id", "page", "page_id", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "l"))
    return cut.select("document_id", "page", "page_id", "l.line_no", "l.line", F.col("i").alias("place"), (F.col("n") - 1 - F.col("i")).alias("back"))


def edge_key(line: Column) -> Column:
    """A line's letters in lower case, look-alikes made letters, without page numbers."""
    x = F.lower(F.regexp_replace(line, PAGE_INSIDE, " "))
    x = F.translate(x, "0!5@69", "oisabg")
    return F.regexp_replace(x, r"[^\p{L}]+", "")


def _spans(text: Column, starts: Column, size: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(F.substring(text, i + 1, size).alias("part"), i.cast("int").alias("at")))


def alike_keys(keys: DataFrame, dense: int = DENSE_KEYS) -> DataFrame:
    """(document_id, slot, key, anchor) of every two of a slot's distinct keys within the anchor's edit distance, itself included.

    Up to ``dense`` keys a slot are compared each with each. In longer documents an anchor within d
    edits is cut into d + 1 parts, one of which every key alike must hold unchanged, shifted by d at
    most: keys meet by such parts. Both ways find the same pairs.
    """
    most = lambda c: F.greatest(F.lit(2), F.floor(F.length(c) / 5)).cast("int")
    sizes = keys.groupBy("document_id", "slot").agg(F.count("*").alias("n"))
    k = keys.join(sizes, ["document_id", "slot"])
    whole = F.array(F.struct(F.lit("").alias("part"), F.lit(0).alias("at")))
    n, m = F.length("key"), most("key") + 1
    cuts = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(F.floor(i * n / m).cast("int").alias("a"), F.floor((i + 1) * n / m).cast("int").alias("b")))
    parts = F.transform(cuts, lambda c: F.struct(F.substring(F.col("key"), c["a"] + 1, c["b"] - c["a"]).alias("part"), c["a"].alias("at")))
    # keys have 6 letters at least, parts 2 to 5
    grams = F.concat(*[_spans(F.col("key"), F.sequence(F.lit(0), n - g), F.lit(g)) for g in (2, 3, 4, 5)])
    few = F.col("n") <= dense
    left = k.select("document_id", "slot", "key", F.explode(F.when(few, whole).otherwise(grams)).alias("x")).select("document_id", "slot", "key", "x.part", F.col("x.at").alias("key_at"))
    right = k.select("document_id", "slot", F.col("key").alias("anchor"), F.explode(F.when(few, whole).otherwise(parts)).alias("x")).select("document_id", "slot", "anchor", "x.part", "x.at")
    pairs = left.join(right, ["document_id", "slot", "part"]).where(F.abs(F.col("key_at") - F.col("at")) <= most("anchor")).where(F.abs(F.length("key") - F.length("anchor")) <= most("anchor"))
    pairs = pairs.select("document_id", "slot", "key", "anchor").distinct()
    return pairs.where((F.col("key") == F.col("anchor")) | (F.levenshtein("key", "anchor") <= most("anchor")))


def furniture(lines: DataFrame, edge: int = 3, dense: int = DENSE_KEYS) -> DataFrame:
    """(page_id, line_no, running, numbered) of the lines that are furniture.

    A running line lies among the first or last ``edge`` lines of its page and is alike (edit
    distance up to a fifth) an edge line of its document whose likes recur on at least two pages and
    a third of the pages. Every edge line is tried.
    """
    near = lines.where((F.col("place") < edge) | (F.col("back") < edge))
    alone = near.withColumn("alone", F.col("line").rlike(PAGE_NUMBER)).withColumn("key", edge_key(F.col("line")))
    near = alone.where(~F.col("alone") & (F.length("key") >= 6) & ~F.col("line").rlike(r"^\s*(?:\d+(?:\.\d+)+|Section \d+|§)"))
    near = near.withColumn("slot", F.when(F.col("place") < edge, F.lit("t")).otherwise(F.lit("b"))).where("document_id IS NOT NULL")
    near = materialize(near.select("document_id", "slot", "key", "page_id", "line_no", F.col("line").rlike(PAGE_INSIDE).alias("numbered")), "edges")
    alike = materialize(alike_keys(near.select("document_id", "slot", "key").distinct(), dense), "alike")
    support = near.select("document_id", "slot", "key", "page_id").join(alike, ["document_id", "slot", "key"]).groupBy("document_id", "slot", "anchor").agg(F.countDistinct("page_id").alias("n"))
    size = lines.groupBy("document_id").agg(F.countDistinct("page_id").alias("pages"))
    good = support.join(size, "document_id").where((F.col("n") >= 2) & (F.col("n") * 3 >= F.col("pages"))).select("document_id", "slot", "anchor")
    found = alike.join(good, ["document_id", "slot", "anchor"], "left_semi").select("document_id", "slot", "key").distinct()
    running = near.join(found, ["document_id", "slot", "key"], "left_semi").select("page_id", "line_no", F.lit(True).alias("running"), "numbered")
    pages = alone.where("alone").where((F.col("place") < 2) | (F.col("back") < 2)).select("page_id", "line_no", F.lit(False).alias("running"), F.lit(True).alias("numbered"))
    return running.unionByName(pages).groupBy("page_id", "line_no").agg(F.max("running").alias("running"), F.max("numbered").alias("numbered"))


def _parts(line: Column) -> Column:
    """Words of a line: split at white space, dashes and underscores, outer punctuation removed."""
    raw = F.split(line, r"[\s_/—–\-]+")
    clean = F.transform(raw, lambda w: F.regexp_replace(w, r"^[\"'(\[.,;:?·^~|]+|[\"')\].,;:?·^~|]+$", ""))
    return F.filter(clean, lambda w: w.rlike(r"[\p{L}@]|[0-9].*[\p{L}]") & ~w.rlike(r"^[\p{L}]$"))


_BREAK = r"([\p{L}0-9@!]+)[" + HYPHENS + r"]\s*$"
_SOFT = r"[\x{AD}\x{AC}\x{2010}]\s*$"
_FIRST = r"^\W*([\p{L}0-9@!]+)"


def breaks(body: DataFrame) -> DataFrame:
    """(page_id, line_no, left, right, next_page, next_line, soft) of body lines that end at a hyphen."""
    w = W.partitionBy("page_id").orderBy("line_no")
    b = body.withColumn("next_line", F.lead("line_no").over(w)).withColumn("next", F.lead("line").over(w))
    first = body.groupBy("document_id", "page", "page_id").agg(F.min(F.struct("line_no", "line")).alias("first"))
    follow = W.partitionBy("document_id").orderBy("page", "page_id")  # one short row a page
    turn = first.select("page_id", F.lead(F.struct(F.col("page_id").alias("id"), "first")).over(follow).alias("turn"))
    b = b.where(F.col("line").rlike(_BREAK)).join(turn, "page_id", "left")
    here = F.col("next").isNotNull()
    return b.select(
        "page_id", "line_no", F.lower(F.regexp_extract("line", _BREAK, 1)).alias("left"),
        F.lower(F.regexp_extract(F.when(here, F.col("next")).otherwise(F.coalesce("turn.first.line", F.lit(""))), _FIRST, 1)).alias("right"),
        F.when(here, F.col("page_id")).otherwise(F.col("turn.id")).alias("next_page"), F.when(here, F.col("next_line")).otherwise(F.col("turn.first.line_no")).alias("next_line"),
        F.col("line").rlike(_SOFT).alias("soft"),
    )


def detect(pages: DataFrame, *, seed: int = 5) -> dict[str, DataFrame]:
    """All findings: ``lines`` (every line, with running, numbered), ``joins`` (breaks, with ``join``), ``misread`` (page_id, line_no), ``forms`` (form, best).

    Defined cases: null and blank texts have no lines; repeated page ids count once; lines are
    counted from 1 with blank ones; a break before a page that is missing is judged by its first
    part alone; an empty table gives empty results; further columns are ignored.
    """
    spark = pages.sparkSession
    ship_code(spark)
    lines = materialize(page_lines(pages), "ocr-lines")
    marks = furniture(lines)
    lines = materialize(lines.join(marks, ["page_id", "line_no"], "left").withColumn("running", F.coalesce("running", F.lit(False))).withColumn("numbered", F.coalesce("numbered", F.lit(False))), "ocr-marked")
    body = lines.where(~F.col("running") & ~F.col("numbered"))
    cuts = materialize(breaks(body), "ocr-breaks")
    # words that are whole: not the parts at a break
    skip_first = cuts.select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.lit(True).alias("cut"))
    whole = F.regexp_replace("line", _BREAK, "")
    tokens = body.join(skip_first, ["page_id", "line_no"], "left").select("page_id", "line_no", F.when(F.col("cut"), F.regexp_replace(whole, _FIRST, "")).otherwise(whole).alias("line"))
    tokens = materialize(tokens.select("page_id", "line_no", F.explode(_parts(F.col("line"))).alias("raw")).select("page_id", "line_no", F.lower("raw").alias("form")), "ocr-tokens")
    counts = tokens.groupBy("form").agg(F.count("*").alias("n"))
    hyph = body.select(F.explode(F.split(F.lower("line"), r"[^\p{L}\-]+")).alias("c")).where(F.col("c").rlike(r"^\p{L}+(?:-\p{L}+)+$"))
    compounds = hyph.groupBy("c").agg(F.count("*").alias("n"))
    confs = pages.select("page_id", "words").where("words IS NOT NULL").select(F.explode("words").alias("w")).select(F.explode(_parts(F.col("w.text"))).alias("f"), F.col("w.confidence").alias("c")).groupBy(F.lower("f").alias("form")).agg(F.avg(F.when(F.col("c") >= 0, F.col("c"))).alias("conf"))
    vocab = materialize(counts.join(confs, "form", "left"), "ocr-forms")
    # bounded training sample: the commonest words and compounds
    top = [(r["form"], r["n"], r["conf"]) for r in vocab.orderBy(F.desc("n"), "form").limit(TRAIN_WORDS).collect()]
    comp = {r["c"]: r["n"] for r in compounds.where("n >= 2").orderBy(F.desc("n"), "c").limit(TRAIN_WORDS).collect()}
    counted = {w: n for w, n, _ in top}
    pure = [(w, n) for w, n, _ in top if re.fullmatch(r"[a-z]{2,}", w)]
    shapes = {fold_shape(w): n for w, n in reversed(pure)}
    low = [c for w, n, c in top if c and re.search(r"[a-z]", w) and re.search(r"[0-9@!]", w) and shapes.get(fold_shape(w), 0) > 5 * n]
    high = [c for w, n, c in top[:1000] if c and w.isalpha()]
    reader = spark.sparkContext.broadcast(fit_reader(pure, (low, high), seed))
    joiner = spark.sparkContext.broadcast(fit_joiner(counted, comp, seed + 1))

    # joins: counts of the parts, the joined word and the compound
    c1 = vocab.select("form", "n")
    look = lambda d, col, out: d.join(c1.select(F.col("form").alias(col), F.col("n").alias(out)), col, "left")
    j = cuts.withColumn("joined", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    j = look(look(look(j, "left", "n_left"), "right", "n_right"), "joined", "n_joined")
    j = j.join(compounds.select(F.col("c").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
    opens = compounds.groupBy(F.substring_index("c", "-", 1).alias("left")).agg(F.sum("n").alias("n_opens"))
    j = j.join(opens, "left", "left").fillna(0, ["n_left", "n_right", "n_joined", "n_compound", "n_opens"])

    def judge(batches):
        model = joiner.value
        for pdf in batches:
            x = [join_features(*v) for v in zip(pdf["n_left"], pdf["n_right"], pdf["n_joined"], pdf["n_compound"], pdf["n_opens"], pdf["soft"])]
            p = model.predict(np.array(x).reshape(len(x), 7))
            pdf["join"] = (p >= 0.5) & (pdf["left"].str.len() > 0)
            yield pdf[["page_id", "line_no", "left", "right", "next_page", "next_line", "joined", "join"]]

    joins = materialize(j.mapInPandas(judge, "page_id long, line_no int, left string, right string, next_page long, next_line int, joined string, join boolean"), "ocr-joins")

    # forms to judge: all words, and words joined over a break
    extra = joins.where(F.col("join") & (F.col("right") != "")).groupBy(F.col("joined").alias("form")).agg(F.count("*").alias("k"))
    forms = vocab.join(extra, "form", "full").select("form", (F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0))).cast("long").alias("n"), F.coalesce("conf", F.lit(80.0)).alias("conf"))
    forms = materialize(forms, "ocr-all-forms")
    best = materialize(best_candidates(forms, reader), "ocr-best")
    bad = best.select("form")
    plain = tokens.join(bad, "form", "left_semi").select("page_id", "line_no")
    numbers = tokens.where(F.col("form").rlike(r"^(?=.*[0-9])[0-9lo]{2,}$|^l[lo]+$|^[lo]l+$") & F.col("form").rlike("[lo]")).select("page_id", "line_no")
    # a misread word over a break: the line in which it differs from its correction
    over = joins.where("join").join(best, joins["joined"] == best["form"])
    same = F.expr("coalesce(try_element_at(filter(sequence(1, length(joined)), i -> substring(joined, i, 1) <> substring(best, i, 1)), 1), length(joined))")
    over = over.withColumn("in_left", same <= F.length("left"))
    over = over.select(F.when(F.col("in_left"), F.col("page_id")).otherwise(F.col("next_page")).alias("page_id"), F.when(F.col("in_left"), F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"))
    misread = plain.unionByName(numbers).unionByName(over).distinct()
    return {"lines": lines, "joins": joins, "misread": misread, "forms": best}


def best_candidates(forms: DataFrame, reader, *, ratio: float = 4.0, least_count: int = 6, threshold: float = 0.9) -> DataFrame:
    """(form, best, score) of every form that is a misreading; candidates come through shared bigrams.

    A candidate is a word of letters at least ``ratio`` times as common as the form and seen
    ``least_count`` times, whatever the size of the corpus.
    """
    floor = least_count
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, 2)))
    pure = forms.where((F.col("n") >= floor) & F.col("form").rlike(r"^\p{L}{2,}$")).select(F.col("form").alias("cand"), F.col("n").alias("m"), F.explode(grams(F.col("form"))).alias("g"))
    # a ligature stands for its letters, so it shares their bigrams
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace("form", "ﬁ", "fi"), "ﬂ", "fl"), "ﬀ", "ff")
    ours = forms.where(F.length("form") >= 2).withColumn("gs", grams(flat)).select("form", "n", "conf", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    pairs = ours.join(pure, "g").where((F.col("m") >= ratio * F.col("n")) & (F.col("form") != F.col("cand")) & (F.abs(F.length("form") - F.length("cand")) <= 2))
    pairs = pairs.groupBy("form", "n", "conf", "size", "cand", "m").agg(F.count("*").alias("shared"))
    pairs = pairs.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("size") * 0.34)))

    def rank(batches):
        model = reader.value
        for pdf in batches:
            keep = [edits(w, c, 3) <= (2 if len(c) < 6 else 3) for w, c in zip(pdf["form"], pdf["cand"])]
            pdf = pdf[keep]
            x = [pair_features(w, c, n, m, k) for w, c, n, m, k in zip(pdf["form"], pdf["cand"], pdf["n"], pdf["m"], pdf["conf"])]
            x = np.array(x).reshape(len(x), 10)
            # equal scores: the closer shape, then the fewer edits
            yield pdf.assign(score=model.predict(x), near=-x[:, 2] - 0.1 * x[:, 1])[["form", "cand", "m", "score", "near"]]

    ranked = pairs.select("form", "n", "conf", "cand", "m").mapInPandas(rank, "form string, cand string, m long, score double, near double").where(F.col("score") >= threshold)
    return ranked.groupBy("form").agg(F.max_by("cand", F.struct(F.round("score", 2), "near", "m", "cand")).alias("best"), F.max("score").alias("score"))


def noise_table(found: dict[str, DataFrame]) -> DataFrame:
    """(page_id, line_no, noise_type), once for each type."""
    lines, joins = found["lines"], found["joins"]
    out = lines.where("running").select("page_id", "line_no", F.lit("running_line").alias("noise_type"))
    out = out.unionByName(lines.where("numbered").select("page_id", "line_no", F.lit("page_number").alias("noise_type")))
    out = out.unionByName(joins.where("join").select("page_id", "line_no", F.lit("hyphen").alias("noise_type")))
    out = out.unionByName(found["misread"].select("page_id", "line_no", F.lit("misread").alias("noise_type")))
    return out.distinct()


def repair(pages: DataFrame) -> DataFrame:
    """(document_id, page, paragraph_no, text): continuous paragraphs, in reading order.

    Furniture goes, broken words are joined on the line where they begin, misread words are replaced
    by their best candidate, specks vanish; a blank line or a numbered heading starts a paragraph,
    and a paragraph that a page break cuts (its last line does not end a sentence) goes on.
    """
    found = detect(pages)
    body = found["lines"].where(~F.col("running") & ~F.col("numbered"))
    joins = found["joins"].where(F.col("join") & F.col("right").isNotNull())
    head = joins.select("page_id", "line_no", "right", F.lit(True).alias("opens"))
    tail = joins.select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.lit(True).alias("closes"))
    d = body.join(head, ["page_id", "line_no"], "left").join(tail, ["page_id", "line_no"], "left")
    text = F.when(F.col("closes"), F.regexp_replace("line", _FIRST, "")).otherwise(F.col("line"))
    text = F.when(F.col("opens"), F.concat(F.regexp_replace(text, r"[" + HYPHENS + r"]\s*$", ""), "right")).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"(?<=\s|^)" + SPECKS + r"(?=\s|$)", " "))
    d = d.withColumn("text", text)
    # corrections: word by word, through the same forms
    words = d.select("document_id", "page", "page_id", "line_no", F.posexplode(F.split("text", r"\s+")).alias("i", "w"))
    words = words.withColumn("form", F.lower(F.regexp_replace("w", r"^[\"'(\[.,;:?]+|[\"')\].,;:?]+$", "")))
    words = words.join(found["forms"].select("form", "best"), "form", "left")
    first = F.col("w").rlike(r"^[\"'(\[]*\p{Lu}")
    fixed = F.when(F.col("best").isNull() | (F.length("form") == 0), F.col("w")).otherwise(F.expr("replace(w, regexp_extract(w, '[^\"\\'(\\\\[.,;:?].*[^\"\\')\\\\].,;:?]|[^\"\\'(\\\\[.,;:?]', 0), " + "best)"))
    fixed = F.when(F.col("best").isNotNull() & first, F.concat(F.upper(F.substring(fixed, 1, 1)), F.substr(fixed, F.lit(2)))).otherwise(fixed)
    line = words.groupBy("document_id", "page", "page_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", fixed.alias("t")))), lambda s: s["t"]), " ").alias("text"))
    w = W.partitionBy("document_id").orderBy("page", "page_id", "line_no")
    prev_line, prev_page, prev_text = F.lag("line_no").over(w), F.lag("page_id").over(w), F.lag("text").over(w)
    heading = r"^(?:\d+(?:\.\d+)+ |Section \d+)"
    same_page = prev_page == F.col("page_id")
    starts = prev_line.isNull() | F.col("text").rlike(heading) | prev_text.rlike(heading) | (same_page & (F.col("line_no") > prev_line + 1)) | (~same_page & prev_text.rlike(r"[.!?:]$"))
    para = line.withColumn("s", F.when(starts, 1).otherwise(0)).withColumn("paragraph_no", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_id", "line_no", "text"))), lambda s: s["text"]), " ")
    # a compound that was broken at its own hyphen keeps it, without the space
    out = para.groupBy("document_id", "paragraph_no").agg(F.min("page").alias("page"), F.regexp_replace(joined, r"(?<=\p{L})- (?=\p{Ll})", "-").alias("text"))
    return out.select("document_id", "page", "paragraph_no", "text")
