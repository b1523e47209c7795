"""Variant spellings of names typed by people, linked to known entries and grouped among themselves.

1. Names become bags of normalised tokens: accents, case, titles and punctuation go, joined words
   are parted. Equal bags are one row from here on.
2. Short forms are learned, not listed: a token is short for a given name if it stands with that
   name's families far more often than with others' (:func:`learn_short_forms`), in the aliases or
   in the typed names, or if its stem lies in the name (:func:`resembles`). A firm's acronym of one
   owner stands for the firm's words. Both stand for the meant words in the vectors.
3. Each distinct token is a unit vector of its character trigrams, weighted by inverse frequency.
   A sparse cosine join (:func:`sparse_join`: shared dimensions meet in a shuffled join, hot ones
   salted by their counts, products are summed, the top n above a threshold stay) meets the typed
   tokens with the entries' tokens. A name is then a vector over the entries' tokens, weighted by
   their inverse frequency and by the cosines just found, and the same join meets names and
   entries. No index leaves the cluster: only the trigrams' weights (38 symbols, so 54,872 at most)
   and the words common to a hundredth of the firms are broadcast.
4. Average linkage decides: the mean cosine of a name with all members of an entry's cluster is its
   product with the mean of their vectors, so clusters are averaged by a distributed aggregation. A
   name joins the cluster of highest average, if that is high enough and an exact check token by
   token (family and given name, firm name and trade) lets it in at all.
5. Names that mean no entry are grouped among themselves by average linkage, in rounds of
   reciprocal merges (:func:`average_linkage`).
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from koengine.runtime import materialize, ship_code, shuffle_parts

#: Products of one dimension (left rows times right rows) beyond which its rows are spread over several tasks.
HOT_PRODUCTS = 2_000_000

# Titles, legal forms and joining words that carry no identity.
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame herr frau mme mlle m dipl ing dipling med jur hon rev señor senor sr sra jr ii iii phd msc".split())
LEGAL = frozenset("llc inc incorporated ltd limited gmbh sa ab oy pty proprietary plc ag kg corp corporation co company cie nv bv se spa srl lp llp".split())
JOINING = frozenset("the of and und for".split())


def tokens_of(name: str | None) -> list[str]:
    """Lower-case tokens without accents, titles and punctuation; a comma's second half comes first."""
    if not name:
        return []
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]*)", " ", s.replace("GmbH", "gmbh"))
    s = s.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("'", "").replace("’", "").replace("`", "")
    if s.count(",") == 1:
        a, b = s.split(",")
        s = f"{b} {a}"
    s = re.sub(r"\b([a-z])\.[ ]?(?=[a-z]\b)", r"\1", s) if re.search(r"\b[a-z]\.[a-z]\.", s) else s
    out = [t for t in re.split(r"[^a-z0-9]+", s) if t]
    out = [t for t in out if t not in TITLES or len(out) <= 1 or t == "m"]
    return [t for t in out if t not in JOINING]


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # every edit brings in or takes out one letter at most
    sa, sb = set(a), set(b)
    if len(sa - sb) > most or len(sb - sa) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    if most == 1:
        return 1 if (len(a), len(b)) == (1, 1) or (len(a) == 2 and a == b[::-1]) else 2
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            nxt.append(v)
        if min(nxt) > most:
            return most + 1
        before, row = row, nxt
    return row[-1]


def near(a: str, b: str) -> bool:
    """The same word but for a slip of the hand: one edit, two in long words."""
    n = max(len(a), len(b))
    if min(len(a), len(b)) < 3:
        return a == b
    most = 1 if n < 8 else 2
    return edits(a, b, most) <= most


def abbreviates(short: str, word: str) -> bool:
    """``short`` is a cut-off or contracted form of ``word`` (``instr``, ``intl``, ``shpg``)."""
    if len(short) < 3 or len(short) >= len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(maxsize=100_000)
def _sounds(w: str) -> str:
    """A word with letters of one sound made one and doubled letters single."""
    for a, b in (("ch", "k"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("c", "k"), ("q", "k"), ("y", "i"), ("z", "s"), ("w", "v")):
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(maxsize=200_000)
def resembles(short: str, given: str) -> bool:
    """By sound: ``short``, with or without a diminutive ending, lies in ``given`` or (two letters) opens it."""
    if len(short) < 3 or len(short) >= len(given):
        return False
    s, g = _sounds(short), _sounds(given)
    stem = re.sub(r"(?:ie|ei|e|i|a|o|er)$", "", s)
    if len(stem) < 3:
        return s in g if stem == s or len(s) > 2 and s in g else g.startswith(stem)
    return stem in g or (s != stem and s[-1] == "i" and s[:2] == g[:2])


# ---- entries


def initials(t: list[str]) -> list[str]:
    """Acronyms of a firm: of all words, and with one letter for a legal form of several words."""
    body, legal = [x[0] for x in t if x not in LEGAL], [x[0] for x in t if x in LEGAL]
    return sorted({"".join(body + legal), "".join(body + legal[:1])})


class Words:
    """Words of many firms' names (trades, "international"): they do not tell firms apart by themselves."""

    def __init__(self, common: frozenset[str]):
        self.common = common
        self.known: dict[str, set[str]] = {}

    def meanings(self, t: str) -> set[str]:
        """Common words that a token may stand for."""
        got = self.known.get(t)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[t] = self._meanings(t)
        return got

    def _meanings(self, t: str) -> set[str]:
        if t in self.common:
            return {t}
        got = {w for w in self.common if abbreviates(t, w) and w.startswith(t)} or {w for w in self.common if abbreviates(t, w)}
        return got or {w for w in self.common if len(t) >= 4 and near(t, w)}


def parse(toks: list[str], person: bool, words: Words) -> tuple[list[str], list[str], list[str]]:
    """(given and family, initials) of a person, (own words, trade words) of a firm, as (head, rest, legal)."""
    if person:
        full = [x for x in toks if len(x) > 1]
        return ([full[0], full[-1]] if full else ["", ""]), [x for x in toks if len(x) == 1], []
    legal = [x for x in toks if x in LEGAL]
    return [x for x in toks if x not in words.common and x not in LEGAL], [x for x in toks if x in words.common], legal


def _given(t: str, given: str, shorts: frozenset, alone: bool) -> float:
    if t == given:
        return 1.0
    if (t, given) in shorts:
        return 0.95
    if len(t) == 1:
        # an initial names the entry only if no other entry shares initial and family name
        return 0.6 if t == given[:1] and alone else 0.0
    if len(t) >= 4 and near(t, given):
        return 0.9
    return 0.7 if resembles(t, given) else 0.0


def fit_person(toks: list[str], head: list[str], mids: frozenset, shorts: frozenset, alone: bool) -> float:
    """How well a name's tokens fit a person, 0 if they do not."""
    given, family = head
    if len(toks) == 1:
        return 0.7 if len(given) > 2 and near(toks[0], given + family) or near(toks[0], family + given) else 0.0
    best = 0.0
    for i, fam in enumerate(toks):
        if not near(fam, family):
            continue
        slip = edits(fam, family)
        for j, giv in enumerate(toks):
            if j == i:
                continue
            g = _given(giv, given, shorts, alone)
            if not g:
                continue
            rest = [t for k, t in enumerate(toks) if k not in (i, j)]
            if any(len(t) > 1 for t in rest) or (mids and any(t not in mids for t in rest)):
                continue
            if rest and not mids:
                g -= 0.15
            best = max(best, g - 0.05 * slip)
    return best


def fit_firm(toks: list[str], core: list[str], trade: list[str], alone: bool, words: Words) -> float:
    """How well a name's tokens fit a firm, 0 if they do not. ``alone``: no other firm has these own words."""
    mine = [t for t in toks if t not in LEGAL]
    if not core or not mine:
        return 0.0
    left, slips = list(mine), 0
    for c in core:
        hit = min((t for t in left if near(t, c)), key=lambda t: edits(t, c), default=None)
        if hit is None:
            return 0.7 if len(mine) == 1 and _joined(mine[0], "".join(core), "".join(trade)) else 0.0
        left.remove(hit)
        slips += edits(hit, c)
    known = set(trade)
    for t in left:
        m = words.meanings(t)
        if not (m & known):
            return 0.0
        known -= {min(m & known)}
    if not left and trade:
        # the bare firm name is enough only if no other firm bears it
        return 0.65 - 0.05 * slips if alone else 0.0
    return 1.0 - 0.05 * slips - 0.05 * len(known)


def _joined(word: str, core: str, trade: str) -> bool:
    for cut in range(max(3, len(core) - 1), min(len(word), len(core) + 1) + 1):
        rest = word[cut:]
        if near(word[:cut], core) and (near(rest, trade) or abbreviates(rest, trade)):
            return True
    return False


_TOKENS = F.pandas_udf(lambda s: s.map(tokens_of), T.ArrayType(T.StringType()))  # type: ignore[call-overload]


def _bags(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with ``toks``, and ``bag``: its tokens in order of the alphabet."""
    return df.select(*keep, _TOKENS("name").alias("toks")).where(F.size("toks") > 0).withColumn("bag", F.array_join(F.array_sort("toks"), " "))


def common_words(firms: DataFrame) -> frozenset[str]:
    """Words in at least three and a hundredth of the firms' names: some hundreds at most, whatever the number of firms."""
    n = firms.count()
    each = firms.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").count().where(F.col("count") >= max(3, n // 100))
    return frozenset(r["t"] for r in each.collect() if r["t"] not in LEGAL)


def known_entries(entries: DataFrame) -> tuple[DataFrame, Words]:
    """(koid, person, toks, head, rest, alone, acros, aliases) of every entry."""
    spark = entries.sparkSession
    rows = entries.where("koid IS NOT NULL AND name IS NOT NULL").groupBy("koid").agg(F.min("name").alias("name"), F.first("type_name", True).alias("type_name"), F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"))
    base = materialize(_bags(rows, "koid", (F.coalesce("type_name", F.lit("")) == "Person").alias("person"), "aliases"), "entries")
    words = Words(common_words(base.where(~F.col("person"))))
    shared = spark.sparkContext.broadcast(words)

    def cut(batches):
        for pdf in batches:
            got = [parse(list(t), p, shared.value) for t, p in zip(pdf["toks"], pdf["person"])]
            pdf["head"], pdf["rest"] = [g[0] for g in got], [g[1] for g in got]
            pdf["acros"] = [[] if p else initials(list(t)) for t, p in zip(pdf["toks"], pdf["person"])]
            yield pdf[["koid", "person", "toks", "head", "rest", "acros", "aliases"]]

    cut_up = base.mapInPandas(cut, "koid string, person boolean, toks array<string>, head array<string>, rest array<string>, acros array<string>, aliases array<string>")
    # who shares initial and family name, or all own words
    same = F.when(F.col("person"), F.concat_ws(" ", F.substring(F.element_at("head", 1), 1, 1), F.element_at("head", 2))).otherwise(F.array_join(F.array_sort("head"), " "))
    keyed = cut_up.withColumn("same", same).withColumn("alone", F.count("*").over(W.partitionBy("person", "same")) == 1)
    return materialize(keyed.drop("same"), "entries-known"), words


def learn_short_forms(bags: DataFrame, known: DataFrame, *, least: int = 3, share: float = 0.2) -> DataFrame:
    """(token, given): tokens that stand for a given name, learned from the families they are typed with.

    A token counts with a given name once for each family that only entries of this given name
    bear. It is a short form if at least ``least`` families show it (an entry's alias counts for two)
    and they make ``share`` of all families it stands with; two are enough if they make half.
    """
    person = known.where("person").select(F.element_at("head", 1).alias("given"), F.element_at("head", 2).alias("family"), "aliases").where(F.length("family") >= 4)
    alias = _bags(person.select("given", "family", F.explode("aliases").alias("name")), "given", "family").select("given", "family", F.explode("toks").alias("token"), F.lit(2).alias("n"))
    alias = alias.where(F.levenshtein("token", "family") > F.greatest(F.lit(2), F.length("family") / 3))
    alone = person.groupBy("family").agg(F.min("given").alias("given"), F.max("given").alias("other")).where("given = other").select("family", "given")
    typed = bags.where(F.size("toks").between(2, 3)).select(F.explode("toks").alias("family"), "toks").join(alone, "family")
    typed = typed.select("given", "family", F.explode("toks").alias("token"), F.lit(1).alias("n"))
    seen = typed.unionByName(alias).where((F.length("token") >= 2) & (F.col("token") != F.col("family"))).groupBy("given", "family", "token").agg(F.max("n").alias("n"))
    pairs = seen.groupBy("token", "given").agg(F.sum("n").alias("n"))
    total = pairs.groupBy("token").agg(F.sum("n").alias("total"))
    got = pairs.join(total, "token").where((F.col("token") != F.col("given")) & (((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))) | ((F.col("n") >= 2) & (F.col("n") * 2 >= F.col("total")))))
    return got.select("token", "given")


# ---- vectors and the sparse join


def grams(tok: str) -> dict[str, float]:
    """Trigram counts of the padded token."""
    out: dict[str, float] = defaultdict(float)
    p = f"^{tok}$"
    for i in range(len(p) - 2):
        out[p[i : i + 3]] += 1.0
    return out


def gram_vectors(tokens: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, dim, w) of both tables of ``token``: unit trigram vectors, weighted by inverse frequency over ``known``.

    A trigram that no known token has weighs as the mean of the others; it counts in the length
    only. Ids are hashes: should two tokens share one, the exact check parts them.
    """
    spark = tokens.sparkSession
    parts = shuffle_parts(spark)
    tri = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.concat(F.lit("^"), F.col("token"), F.lit("$")), i, 3))
    counts = {r["g"]: r["count"] for r in known.select(F.explode(F.array_distinct(tri)).alias("g")).groupBy("g").count().collect()}
    n = known.count()
    idf = {g: float(np.log((1 + n) / (1 + c)) + 1) for g, c in counts.items()}
    mean = sum(idf[g] * counts[g] for g in idf) / max(1, sum(counts.values()))
    weights = spark.sparkContext.broadcast((idf, mean or 1.0))

    def run(batches):
        idf, other = weights.value
        place = {g: i for i, g in enumerate(sorted(idf))}
        for pdf in batches:
            ks, gs, ws = [], [], []
            for k, tok in zip(pdf["id"], pdf["token"]):
                v = {g: c * idf.get(g, other) for g, c in grams(tok).items()}
                norm = sum(x * x for x in v.values()) ** 0.5
                for g, x in v.items():
                    if g in place:
                        ks.append(k)
                        gs.append(place[g])
                        ws.append(x / norm)
            yield pd.DataFrame({"id": pd.Series(ks, dtype="int64"), "dim": pd.Series(gs, dtype="int64"), "w": pd.Series(ws, dtype="float64")})

    # few bytes but much work a row: spread over all tasks, whatever their size
    out = lambda d: d.select(F.xxhash64("token").alias("id"), "token").repartition(parts).mapInPandas(run, "id long, dim long, w double")
    return out(tokens), out(known)


def heaviest(vectors: DataFrame, share: float) -> DataFrame:
    """Vectors (id, dim, w) cut to their heaviest dimensions that make up ``share`` of the squared length.

    These are the posting lists of the join: what meets only the rest has a cosine below
    ``sqrt(1 - share)``. Dimensions of equal weight at the cut all stay.
    """
    order = W.partitionBy("id").orderBy(F.desc("w"))
    before = F.sum(F.col("w") * F.col("w")).over(order) - F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id", "w"))
    whole = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id"))
    return vectors.withColumn("before", before / whole).where(F.col("before") < share).drop("before")


def sparse_join(left: DataFrame, right: DataFrame, *, least: float, top_n: int | None, name: str = "pairs") -> DataFrame:
    """(a, b, cosine) of every ``a`` with its ``top_n`` most similar ``b`` of cosine ``least`` or more.

    Both tables are sparse unit vectors (id, dim, w). Rows meet by shared dimensions, products are
    summed. Dimensions of many products are spread over several tasks: the left side by a hash of
    its ids, the right side repeated. Rows tied at the cut all stay.
    """
    size = left.groupBy("dim").agg(F.count("*").alias("nl")).join(right.groupBy("dim").agg(F.count("*").alias("nr")), "dim")
    hot = size.where(F.col("nl") * F.col("nr") > HOT_PRODUCTS).select("dim", F.ceil(F.col("nl") * F.col("nr") / HOT_PRODUCTS).cast("int").alias("parts"))
    hot = materialize(hot, f"{name}-hot")
    parts = F.coalesce("parts", F.lit(1))
    tasks = shuffle_parts(left.sparkSession)  # few bytes, many products: not to be coalesced by size
    ours = left.join(hot, "dim", "left").select(F.col("id").alias("a"), "dim", F.col("w").alias("wa"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    theirs = right.join(hot, "dim", "left").select(F.col("id").alias("b"), "dim", F.col("w").alias("wb"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    summed = ours.repartition(tasks, "dim", "part").join(theirs.repartition(tasks, "dim", "part"), ["dim", "part"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)
    if top_n is None:
        return summed
    best = W.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)))
    return summed.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top_n).drop("rank")


def name_vectors(bags: DataFrame, matches: DataFrame, idf: DataFrame, id_: str) -> DataFrame:
    """(id, dim, w): names as unit vectors over known tokens (dim is a hash), each token by what it matches (token, dim, cosine).

    A token counts in the length by its best match alone; one without a match by the mean weight.
    Legal forms are left out.
    """
    each = bags.select(F.xxhash64(id_).alias("id"), F.explode("toks").alias("token")).where(~F.col("token").isin(*LEGAL))
    hits = matches.join(idf, "dim").select("token", "dim", "cosine", "idf")
    own = hits.groupBy("token").agg(F.max_by("idf", F.struct("cosine", "idf")).alias("own"))
    # an initial says little, whatever it might stand for
    weight = F.when(F.length("token") == 1, 1.0).otherwise(F.coalesce("own", "mean", F.lit(1.0)))
    mean = idf.agg(F.avg("idf").alias("mean"))
    length = each.join(own, "token", "left").join(F.broadcast(mean)).groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("length"))
    part = each.join(hits, "token").groupBy("id", "dim").agg(F.sum(F.col("cosine") * F.col("idf")).alias("w"))
    return part.join(length, "id").select("id", "dim", (F.col("w") / F.col("length")).alias("w"))


def _token_matches(tokens: DataFrame, known_tokens: DataFrame, words: Words, shorts: DataFrame | None, least: float, top_n: int) -> DataFrame:
    """(token, dim, cosine): each typed token and the known tokens it may stand for."""
    spark = tokens.sparkSession
    ours, theirs = gram_vectors(tokens, known_tokens)
    met = sparse_join(ours, heaviest(theirs, 0.98), least=least, top_n=top_n, name="tokens")
    met = met.join(tokens.select(F.xxhash64("token").alias("a"), "token"), "a").join(known_tokens.select(F.xxhash64("token").alias("b"), F.col("token").alias("dim")), "b")
    near_by = met.select("token", "dim", F.least("cosine", F.lit(1.0)).alias("cosine"))
    shared = spark.sparkContext.broadcast(words)

    def meant(batches):
        for pdf in batches:
            rows = [(t, m, 0.9) for t in pdf["token"] if len(t) >= 3 and t not in shared.value.common for m in sorted(shared.value.meanings(t))]
            yield pd.DataFrame(rows, columns=["token", "dim", "cosine"])

    out = near_by.unionByName(tokens.select("token").mapInPandas(meant, "token string, dim string, cosine double"))
    if shorts is not None:
        out = out.unionByName(shorts.select("token", F.col("given").alias("dim"), F.lit(0.95).alias("cosine")))
    return materialize(out.groupBy("token", F.xxhash64("dim").alias("dim")).agg(F.max("cosine").alias("cosine")), "token-matches")


def _candidates(bags: DataFrame, known: DataFrame, words: Words, shorts: DataFrame | None, *, top_n: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs (bid, kid, cosine) of names and entries by the hashes of bag and koid, the vectors of both, and the tokens' weights."""
    own = known.select("koid", F.array_distinct("toks").alias("toks"))
    known_tokens = materialize(own.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "known-tokens")
    n = known.count()
    idf = known_tokens.select(F.xxhash64("token").alias("dim"), (F.log(F.lit(1.0 + n) / (1.0 + F.col("n"))) + 1.0).alias("idf"))
    tokens = materialize(bags.select(F.explode("toks").alias("token")).distinct(), "tokens")
    matches = _token_matches(tokens, known_tokens, words, shorts, 0.2, 40)
    ours = materialize(name_vectors(bags, matches, idf, "bag"), "name-vectors")
    exact = known_tokens.select("token", F.xxhash64("token").alias("dim"), F.lit(1.0).alias("cosine"))
    theirs = materialize(name_vectors(own, exact, idf, "koid"), "entry-vectors")
    # an entry is found by the tokens that make up most of it: by a given name or a trade alone it is not
    pairs = sparse_join(ours, heaviest(theirs, 0.75), least=least, top_n=top_n, name="names").select(F.col("a").alias("bid"), F.col("b").alias("kid"), F.least("cosine", F.lit(1.0)).alias("cosine"))
    return pairs, ours, theirs, idf


def _fits(pairs: DataFrame, bags: DataFrame, known: DataFrame, words: Words, shorts: DataFrame, least_fit: float) -> DataFrame:
    """Pairs that pass the exact check token by token, with ``fit``."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    meant = bags.select("bag", F.explode("toks").alias("token")).join(shorts, "token").groupBy("bag").agg(F.collect_set(F.concat_ws(" ", "token", "given")).alias("shorts"))
    full = pairs.join(bags.select(F.xxhash64("bag").alias("bid"), "bag", "toks", "acro_of", "acro"), "bid").join(meant, "bag", "left").join(known.select(F.xxhash64("koid").alias("kid"), "koid", "person", "head", "rest", "alone"), "kid")
    # what cannot pass goes before Python sees it: no token within the edits that the family, or a firm's first own word, allows
    # (a swap is two edits here), unless the name is one word or an acronym
    word = F.when(F.col("person"), F.try_element_at("head", F.lit(2))).otherwise(F.try_element_at("head", F.lit(1)))
    close = F.exists("toks", lambda t: F.levenshtein(t, word) <= F.when(F.greatest(F.length(t), F.length(word)) < 8, 2).otherwise(4))
    single = F.size(F.filter("toks", lambda t: ~t.isin(*LEGAL))) <= 1
    full = full.where(F.col("acro") | single | F.coalesce(close, F.lit(False))).repartition(shuffle_parts(spark))

    def check(batches):
        ws = shared.value
        for pdf in batches:
            fit = []
            for toks, acro, of, sh, koid, person, head, rest, alone in zip(pdf["toks"], pdf["acro"], pdf["acro_of"], pdf["shorts"], pdf["koid"], pdf["person"], pdf["head"], pdf["rest"], pdf["alone"]):
                toks, head, rest = list(toks), list(head), list(rest)
                if person:
                    known_short = frozenset(tuple(x.split(" ", 1)) for x in sh) if sh is not None else frozenset()
                    fit.append(fit_person(toks, head, frozenset(rest), known_short, alone))
                elif acro:
                    fit.append(0.7 if of == koid else 0.0)
                else:
                    fit.append(fit_firm(toks, head, rest, alone, ws))
            pdf["fit"] = pd.Series(fit, dtype="float64")
            yield pdf.loc[pdf["fit"] >= least_fit, ["bag", "koid", "cosine", "fit"]]

    return full.mapInPandas(check, "bag string, koid string, cosine double, fit double")


def _named(names: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, bag) of every name; (bag, toks, acro, acro_of): a row for each distinct bag; a firm's acronym carries its words and, if it is nobody else's, its owner."""
    distinct = names.select("name").where(F.col("name").rlike(r"\S")).distinct().repartition(shuffle_parts(names.sparkSession))
    each = materialize(_bags(distinct, "name"), "names")
    bags = each.groupBy("bag").agg(F.min("toks").alias("toks"))
    acros = known.where(~F.col("person")).select(F.explode("acros").alias("bag"), "koid", "toks").groupBy("bag").agg(F.min("koid").alias("acro_of"), F.max("koid").alias("other"), F.min("toks").alias("meant"))
    acros = acros.where((F.length("bag") > 1) & (F.length("bag") <= 6)).select("bag", F.when(F.col("acro_of") == F.col("other"), F.col("acro_of")).alias("acro_of"), F.when(F.col("acro_of") == F.col("other"), F.col("meant")).alias("meant"), F.lit(True).alias("acro"))
    out = bags.join(acros, "bag", "left").select("bag", F.coalesce("meant", "toks").alias("toks"), F.coalesce("acro", F.lit(False)).alias("acro"), "acro_of")
    return each.select("name", "bag"), materialize(out, "bags")


def link_names(names: DataFrame, entries: DataFrame, *, top_n: int = 20, least_cosine: float = 0.25, least_fit: float = 0.5, least_average: float = 0.3) -> DataFrame:
    """(name, koid) of every distinct name that means an entry.

    ``names`` has a column ``name``; ``entries`` has koid, name, type_name and aliases, a row for
    each known person or organisation, of any number.

    Defined cases: null and blank names mean nothing; repeated names are linked once; a name that
    stands at the same highest average with several entries means none of them; names of one word
    only mean firms by their acronym or whole name; repeated koids of ``entries`` count once;
    further columns are ignored.
    """
    linked, each, *_ = _link(names, entries, top_n, least_cosine, least_fit, least_average)
    return each.join(linked, "bag").select("name", "koid")


def _link(names: DataFrame, entries: DataFrame, top_n: int, least_cosine: float, least_fit: float, least_average: float) -> tuple[DataFrame, DataFrame, DataFrame, Words, DataFrame]:
    ship_code(names.sparkSession)
    known, words = known_entries(entries)
    each, bags = _named(names, known)
    shorts = materialize(learn_short_forms(bags, known), "short-forms")
    pairs, ours, theirs, _ = _candidates(bags, known, words, shorts, top_n=top_n, least=least_cosine)
    pairs = materialize(_fits(pairs, bags, known, words, shorts, least_fit), "name-pairs")
    mine = ours.withColumnRenamed("id", "bid")
    # a cluster: its entry and the names that can mean that entry alone
    lone = pairs.groupBy("bag").agg(F.min("koid").alias("koid"), F.count("*").alias("n")).where("n = 1").select("bag", "koid", F.xxhash64("bag").alias("bid"), F.xxhash64("koid").alias("kid"))
    total = theirs.select(F.col("id").alias("kid"), "dim", "w").unionByName(lone.join(mine, "bid").select("kid", "dim", "w")).groupBy("kid", "dim").agg(F.sum("w").alias("m"))
    sizes = known.select("koid", F.lit(1).alias("one")).unionByName(lone.select("koid", F.lit(1).alias("one"))).groupBy("koid").agg(F.sum("one").alias("members"))
    self_dot = lone.join(mine, "bid").groupBy("bag", "koid").agg(F.sum(F.col("w") * F.col("w")).alias("self"))
    dots = pairs.withColumn("bid", F.xxhash64("bag")).withColumn("kid", F.xxhash64("koid")).join(mine, "bid").join(total, ["kid", "dim"]).groupBy("bag", "koid").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    linked = pairs.join(dots, ["bag", "koid"]).join(sizes, "koid").join(self_dot, ["bag", "koid"], "left")
    # a member's likeness with itself is no evidence
    average = (F.col("dot") - F.coalesce("self", F.lit(0.0))) / (F.col("members") - F.when(F.col("self").isNotNull(), 1).otherwise(0))
    best = W.partitionBy("bag").orderBy(F.desc("score"))
    scored = linked.withColumn("average", average).where(F.col("average") >= least_average).withColumn("score", F.round(F.col("average") * F.col("fit"), 6))
    ranked = scored.withColumn("rank", F.rank().over(best)).where("rank = 1").groupBy("bag").agg(F.min("koid").alias("koid"), F.count("*").alias("n")).where("n = 1")
    chosen = materialize(ranked.select("bag", "koid"), "name-links")
    return chosen, each, bags, words, shorts


# ---- names without an entry


def average_linkage(nodes: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(node, cluster): average-linkage clusters of ``nodes``; a pair without an edge counts 0.

    ``edges`` (a, b, s) with a < b, once each. In every round each cluster finds its nearest by mean
    similarity, and pairs that are each other's nearest merge if the mean is ``least`` or more; the
    result is that of merging one pair at a time. Ends when no pair merges. A cluster is named by
    its smallest node.
    """
    at = materialize(nodes.select("node", F.col("node").alias("cluster"), F.lit(1).cast("long").alias("size")), "link-nodes")
    links = materialize(edges.select("a", "b", F.col("s").alias("total")), "link-edges")
    while True:
        size = at.groupBy("cluster").agg(F.count("*").alias("size"))
        mean = links.join(size.select(F.col("cluster").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("size").alias("nb")), "b")
        mean = mean.select("a", "b", F.round(F.col("total") / (F.col("na") * F.col("nb")), 9).alias("s")).where(F.col("s") >= least)
        both = mean.select("a", "b", "s").unionByName(mean.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
        # ties by the pair's smaller, then larger node, so that the two sides agree
        first = both.groupBy("a").agg(F.min_by("b", F.struct(-F.col("s"), F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
        back = first.select(F.col("a").alias("b"), F.col("b").alias("a"))
        merge = materialize(first.join(back, ["a", "b"]).where("a < b").select(F.col("b").alias("old"), F.col("a").alias("new")), "link-merges")
        if merge.isEmpty():
            return at.select("node", "cluster")
        moved = lambda d, c: d.join(merge.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        at = materialize(moved(at, "cluster").select("node", "cluster", "size"), "link-nodes")
        again = moved(moved(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total")
        links = materialize(again.groupBy("a", "b").agg(F.sum("total").alias("total")), "link-edges")


def group_names(names: DataFrame, entries: DataFrame, *, top_n: int = 20, least_cosine: float = 0.25, least_fit: float = 0.5, least_average: float = 0.3) -> DataFrame:
    """(name, group) of every distinct name that is not blank: the koid of the entry it means, or else the bag of its group.

    Names without an entry are typed variants of each other if the exact check lets one in as the
    other; average linkage over the cosines of such pairs makes the groups. A name alone is a group.
    """
    linked, each, bags, words, shorts = _link(names, entries, top_n, least_cosine, least_fit, least_average)
    rest = materialize(bags.join(linked, "bag", "left_anti"), "unlinked")
    shared = names.sparkSession.sparkContext.broadcast(words)

    def cut(batches):
        for pdf in batches:
            toks = [list(t) for t in pdf["toks"]]
            # a legal form, a trade or a number makes a firm; what else has two words or more is a person
            pdf["person"] = [2 <= len([x for x in t if len(x) > 1]) + ([len(x) for x in t].count(1) > 0) and not any(x in LEGAL or x in shared.value.common or x.isdigit() for x in t) for t in toks]
            got = [parse(t, p, shared.value) for t, p in zip(toks, pdf["person"])]
            pdf["head"], pdf["rest"] = [g[0] for g in got], [g[1] for g in got]
            yield pdf[["koid", "toks", "person", "head", "rest"]]

    as_known = rest.select(F.col("bag").alias("koid"), "toks").mapInPandas(cut, "koid string, toks array<string>, person boolean, head array<string>, rest array<string>")
    as_known = materialize(as_known.withColumn("alone", F.lit(False)), "unlinked-parsed")
    pairs, *_ = _candidates(rest, as_known, words, shorts, top_n=top_n, least=least_cosine)
    pairs = _fits(pairs.where("bid <> kid"), rest, as_known, words, shorts, least_fit)
    edges = pairs.groupBy(F.least("bag", "koid").alias("a"), F.greatest("bag", "koid").alias("b")).agg(F.max("cosine").alias("s"))
    groups = average_linkage(rest.select(F.col("bag").alias("node")), edges, max(least_average, 0.5))
    label = groups.select(F.col("node").alias("bag"), F.col("cluster").alias("group"))
    return each.join(linked.select("bag", F.col("koid").alias("group")).unionByName(label), "bag").select("name", "group")
