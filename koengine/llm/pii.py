"""Personal information in free text: bootstrapped contextual extraction.

1. Every text is read once for candidates: e-mail addresses, runs of digits and document numbers,
   postal addresses and person-like word groups, each with its shape (digits as 0, letters as A) and
   the lexical patterns around it (two words to the left, one on each side, two to the right; other
   candidates stand as classes).
2. Seeds label some candidates: cue words beside numbers and addresses, known given names in names.
3. Spark scores the graph of patterns and candidates iteratively: a pattern is as good as the share
   of labelled or already believed candidates it extracts, a candidate as believable as its patterns
   and shape. So shapes seen after "tel" reveal numbers without a cue, and patterns around known
   names reveal unknown ones.
4. Candidates above the threshold are the findings; overlaps go to the stronger one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from koengine.runtime import materialize, ship_code

#: Distinct given names that may be broadcast; more are refused, not dropped.
MAX_GIVEN_NAMES = 2_000_000

_L = r"[^\W\d_]"
EMAIL = re.compile(
    r"(?<![\w.+\-@])[A-Za-z0-9](?:[\w.+\-]*[A-Za-z0-9_])?(?:@| @ |\(at\)|\[at\]| \(at\) | \[at\] )(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.|\(dot\)|\[dot\]| \(dot\) | \[dot\] ))+[A-Za-z]{2,12}(?![\w@\-])"
)
_CITY = r"[^\W\d_a-z][\w'’]*(?:[ \-][^\W\d_a-z][\w'’]*){0,2}"
# Words for streets and post boxes.
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Court|Ct\.?|Crescent|Cres\.?|Drive|Dr\.?|Mews|Parade|Row|Place|Pl\.?|Square|Sq\.?|Terrace|Way|Walk|Hill|Yard|Boulevard|Blvd\.?)"
_BOX = r"(?:P\.? ?O\.? ?Box|Post Box|Postbox|Postfach|Boîte postale|B\.?P\.?|Apartado(?: de Correos)?|Apdo\.?)"
ADDRESS = tuple(
    (name, re.compile(p))
    for name, p in (
        ("box", r"(?<!\w)" + _BOX + r" \d[\d ]{0,8}\d?(?:,\s(?:\d{4,5} )?" + _CITY + r")?"),
        ("english", r"(?<![\w/])(?:(?:Flat|Apt\.?|Unit|Suite) \w{1,5}, ?)?\d{1,5}[A-Za-z]? (?:[^\W\d_a-z][\w'’\-]*[ ]){1,3}" + _STREET_EN + r"(?![\w])(?:,\s" + _CITY + r"(?:,? [A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2})?)?"),
        ("french", r"(?<![\w/])\d{1,4}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|chemin|place|allée|impasse|quai|route|cours) [^\n,;]{2,40}(?:,\s\d{5} " + _CITY + r")?"),
        ("german", r"(?<!\w)(?:[^\W\d_a-z][\wäöüß\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|graben)|[^\W\d_a-z][\w\-]*(?:er|er-| )? ?(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring)) \d{1,4} ?[a-z]?(?![\w.])(?:,\s(?:D-)?\d{4,5} " + _CITY + r")?"),
        ("spanish", r"(?<!\w)(?:c/|C/|calle|Calle|avda\.|Avda\.|avenida|Avenida|av\.|plaza|Plaza|paseo|Paseo) ?[^\n,;\d]{2,30},? \d{1,4}(?:, ?\d{1,2}\.?[ºª°o]? ?[A-Z]?)?(?:,\s(?:\d{5} )?" + _CITY + r")?"),
    )
)
NUMBER = re.compile(
    r"(?<![\w@/`+\-.,:#$€£])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,5}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,17}(?![\w@`])(?![.\-/:]\d)"
    r"|(?<![\w@/`+\-.])\+\d{1,3}[ .\-]?\(\d\)\d{1,4}(?:[ .\-/]?\d){4,12}(?![\w])"
    r"|(?<![\w@/`+\-.])\(\d{2,5}\)[ .\-]?\d(?:[ .\-/]?\d){4,10}(?![\w])"
    r"|(?<![\w@/`\-.])[A-Z]{1,3} ?\d(?: ?\d){5,10}(?: ?[A-Z])?(?![\w\-])"
)
_TITLES = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Dame|Herr|Frau|Mme|Mlle|M|Sr|Sra|Señor|Señora|Ing|Dipl|Rev|Hon)"
_WORD = re.compile(r"[^\W\d_][^\W\d_'’]*(?:-[^\W\d_]+)*|\S", re.U)
_STOPS = frozenset(".!?。！？")
_ABBREVIATED = frozenset("tel no nr dr prof mr mrs ms m ing dipl st".split())
_FIRM = frozenset("llc inc ltd gmbh sa ab oy pty plc ag kg corp co limited incorporated company desk group team rota systems".split())
# Words that announce a type, the seeds of its patterns.
CUES = {
    "PHONE": frozenset("tel tel. telefon téléphone telephone phone fax mobile mobil handy callback llamar teléfono rufnummer hotline cell call".split()),
    "ID_NUMBER": frozenset("passport passeport pasaporte reisepass personalausweis ausweis identity insurance ssn nin dni nif nie versicherungsnummer sozialversicherung".split()),
    "ADDRESS": frozenset("domicile postanschrift anschrift adresse address dirección lives wohnhaft domicilio".split()),
}


def shape_of(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))


def _blocks(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, class, shape) of e-mails, addresses and numbers, without overlaps, in order."""
    got: list[tuple[int, int, str, str]] = [(m.start(), m.end(), "EMAIL", "email") for m in EMAIL.finditer(text)] if "@" in text or "at" in text else []
    for name, p in ADDRESS:
        got += [(m.start(), m.end(), "ADDRESS", name) for m in p.finditer(text)]
    for m in NUMBER.finditer(text):
        s = m.group()
        digits = sum(c.isdigit() for c in s)
        if 6 <= digits <= 17:
            got.append((m.start(), m.end(), "NUMBER", shape_of(s)))
    got.sort(key=lambda x: (x[0], -(x[1] - x[0])))
    out: list[tuple[int, int, str, str]] = []
    for g in got:
        if not out or g[0] >= out[-1][1]:
            out.append(g)
    return out


@lru_cache(maxsize=200_000)
def _kind(w: str) -> str:
    """How a token is written: I or i an initial, U capitals, C capitalised, l small, F a firm's word, else the mark itself or nothing."""
    if not w[0].isalpha():
        return w
    if len(w) == 1:
        return "I" if w.isupper() else ("i" if w.islower() else "")
    if w.lower() in _FIRM:
        return "F"
    if w.isupper():
        return "U"
    if all(p[:1].isupper() and p[1:].islower() for p in re.split(r"[-'’]", w) if p):
        return "C"
    return "l" if w.islower() else ("C" if w[0].isupper() else "")


@lru_cache(maxsize=200_000)
def _given(w: str, given: frozenset[str], short: frozenset[str]) -> tuple[bool, bool]:
    """Whether all parts of a word are known given names; whether they are known or short forms."""
    parts = w.lower().split("-")
    return all(p in given for p in parts), all(p in given or p in short for p in parts)


def _names(toks: list[tuple[str, int, int]], given: frozenset[str], shorts: frozenset[str]) -> list[tuple[int, int, bool, str]]:
    """(first token, last token, seed, shape) of person-like groups of tokens.

    Given + family, given + initial + family, initial + family, family + comma + given (or
    initial); capitals, capitalised, or small letters if a known given name is among them.
    """
    out = []
    n = len(toks)

    kinds = [_kind(t[0]) for t in toks]
    words = ("C", "U", "l")

    def known(i: int) -> bool:
        return _given(toks[i][0], given, shorts)[0]

    def short(i: int) -> bool:
        return _given(toks[i][0], given, shorts)[1]

    for i in range(n):
        a = kinds[i]
        if a in words and i + 1 < n:
            b = kinds[i + 1]
            # small letters only around a known given or short name
            if b == a and (a != "l" or short(i) or short(i + 1)):
                out.append((i, i + 1, known(i) or known(i + 1), "GF" if a != "l" else "gf"))
            j = i + 1
            if b in ("I", "i") and (b == "I") == (a != "l"):
                j = i + 3 if j + 1 < n and kinds[j + 1] == "." else i + 2
                if j < n and kinds[j] == a and (a != "l" or short(i)):
                    out.append((i, j, known(i), "GIF"))
            if b == "," and i + 2 < n:
                c = kinds[i + 2]
                if c == a and (a != "l" or short(i + 2)):
                    out.append((i, i + 2, known(i + 2), "F,G"))
                    if i + 3 < n and kinds[i + 3] in ("I", "i"):
                        e = i + 4 if i + 4 < n and kinds[i + 4] == "." else i + 3
                        out.append((i, e, known(i + 2), "F,GI"))
                elif c in ("I", "i") and a != "l":
                    e = i + 3 if i + 3 < n and kinds[i + 3] == "." else i + 2
                    out.append((i, e, False, "F,I"))
        elif a in ("I", "i"):
            j = i + 2 if i + 1 < n and kinds[i + 1] == "." else i + 1
            if j < n and kinds[j] in words and (kinds[j] != "l") == (a == "I"):
                out.append((i, j, False, "IF"))
            k = j + 2 if j + 1 < n and kinds[j] == "I" and kinds[j + 1] == "." else j + 1
            if j < n and kinds[j] in ("I", "i") and k < n and kinds[k] in words and (kinds[k] != "l") == (a == "I"):
                out.append((i, k, False, "IIF"))
    return out


def read_text(text: str, given: frozenset[str], shorts: frozenset[str] = frozenset()) -> list[tuple]:
    """All candidates of a text: (start, end, class, shape, seeds, l2, l1r1, r2)."""
    blocks = _blocks(text)
    # tokens, with blocks as single tokens
    toks: list[tuple[str, int, int]] = []
    at = 0
    for s, e, c, _ in [*blocks, (len(text), len(text), "", "")]:
        for m in _WORD.finditer(text, at, s):
            toks.append((m.group(), m.start(), m.end()))
        if c:
            toks.append((f"<{c}>", s, e))
        at = e
    place = {t[1]: i for i, t in enumerate(toks)}

    def word(i: int) -> str:
        if i < 0 or i >= len(toks):
            return "^"
        w = toks[i][0]
        return w if w[0] == "<" and len(w) > 1 else re.sub(r"\d+", "0", w.lower())

    def gap(i: int) -> bool:
        """A line end between tokens i and i + 1."""
        return 0 <= i < len(toks) - 1 and "\n" in text[toks[i][2] : toks[i + 1][1]]

    def context(i: int, j: int) -> tuple[str, str, str]:
        # a title belongs to the context, not to the name; its stop is skipped
        l = i - 1
        if l >= 1 and toks[l][0] == "." and re.fullmatch(_TITLES, toks[l - 1][0]):
            l -= 1
        left1 = "^" if gap(l) or l < 0 else word(l)
        if left1 in _STOPS and word(l - 1) not in _ABBREVIATED:
            left1 = "^"
        left2 = "^" if left1 == "^" or gap(l - 1) or l < 1 else word(l - 1)
        right1 = "$" if gap(j) or j + 1 >= len(toks) else word(j + 1)
        right2 = "$" if right1 == "$" or right1 in _STOPS or gap(j + 1) or j + 2 >= len(toks) else word(j + 2)
        return f"{left2} {left1}", f"{left1} _ {right1}", f"{right1} {right2}"

    out = []
    for s, e, c, shape in blocks:
        i = place[s]
        ctx = context(i, i)
        seeds = []
        before = [word(k) for k in range(max(0, i - 4), i)]
        # cues stand within the sentence, before the item
        for k in range(len(before) - 1, -1, -1):
            if before[k] in (".", "!", "?", ";") and not (k and before[k - 1] in ("tel", "no", "nr", "insurance")):
                before = before[k + 1 :]
                break
        for kind, cues in CUES.items():
            if any(b in cues for b in before) and (kind == "ADDRESS") == (c == "ADDRESS"):
                seeds.append(kind)
        out.append((s, e, c, shape, ",".join(seeds[-1:]), *ctx))
    for i, j, seed, shape in _names(toks, given, shorts):
        s, e = toks[i][1], toks[j][2]
        if "\n" in text[s:e]:
            continue
        first = toks[i][0]
        if re.fullmatch(_TITLES, first) and shape != "IF":
            continue
        out.append((s, e, "PERSON", shape, "NAME" if seed else "", *context(i, j)))
    return out


_SCHEMA = "key long, start_at long, end_at long, class string, shape string, seed string, l2 string, m2 string, r2 string"


def _lexicon(words: DataFrame) -> frozenset[str]:
    """All words of one column; their number grows with the variety of names, not with the persons, and is checked."""
    if words.count() > MAX_GIVEN_NAMES:
        raise ValueError(f"more than {MAX_GIVEN_NAMES} distinct given names cannot be broadcast")
    return frozenset(r[0] for r in words.collect())


def find_personal(df: DataFrame, people: DataFrame, *, key: str, text: str, rounds: int = 20, threshold: float = 0.5) -> DataFrame:
    """(key, pii_type, start_at, end_at, score) of every finding, without overlaps.

    ``people`` has a column ``name``: known persons, whose given names are seeds (distinct given
    names only are broadcast, checked against ``MAX_GIVEN_NAMES``); its ``aliases``, if there, give
    short forms. Patterns and candidates score each other until a round believes no further group,
    ``rounds`` times at most. Offsets count code points from 0.

    Defined cases: null and blank texts have none; repeated keys count once, by their largest text;
    equal findings at one place are one; very long texts are read whole; further columns are
    ignored; without any seed of a type nothing of that type but e-mail addresses is found.
    """
    spark = df.sparkSession
    ship_code(spark)
    names = people.where("name IS NOT NULL").select(F.lower(F.regexp_extract("name", r"^(\p{L}{3,})[ ]", 1)).alias("g")).where("g <> ''").groupBy("g").count()
    given = _lexicon(names.select("g"))
    shorts = frozenset()
    if "aliases" in people.columns:  # words of an alias that are not the family name
        family = F.lower(F.regexp_extract("name", r"(\p{L}+)\s*$", 1))
        words = people.select(family.alias("f"), F.explode("aliases").alias("a")).select("f", F.explode(F.split(F.lower("a"), r"[^\p{L}]+")).alias("w"))
        words = words.where((F.length("w") >= 3) & (F.levenshtein("w", "f") > 3)).groupBy("w").count()
        shorts = _lexicon(words.select("w"))
    lexicon = spark.sparkContext.broadcast((given, shorts))
    one = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S") & F.col("key").isNotNull())
    one = one.groupBy("key").agg(F.max("text").alias("text"))

    def read(batches):
        known = lexicon.value
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf["key"], pdf["text"]) for c in read_text(t, *known)]
            yield pd.DataFrame(rows, columns=["key", "start_at", "end_at", "class", "shape", "seed", "l2", "m2", "r2"])

    cands = materialize(one.mapInPandas(read, _SCHEMA), "pii-candidates")
    return score_graph(cands, rounds, threshold)


def score_graph(cands: DataFrame, rounds: int, threshold: float) -> DataFrame:
    """Scores of the pattern-candidate graph; see the module's text."""
    # equal surroundings make equal scores, so the graph is over distinct (class, shape, seed, contexts)
    node = ["class", "shape", "l2", "m2", "r2"]
    groups = materialize(cands.where("class <> 'EMAIL'").groupBy(*node, "seed").agg(F.count("*").alias("n")), "pii-groups")
    kinds = F.when(F.col("class") == "NUMBER", F.array(F.lit("PHONE"), F.lit("ID_NUMBER"))).when(F.col("class") == "ADDRESS", F.array(F.lit("ADDRESS"))).otherwise(F.array(F.lit("NAME")))
    graph = groups.select(*node, "seed", "n", F.explode(kinds).alias("kind")).withColumn("label", F.when(F.col("seed") == F.col("kind"), 1.0).when(F.col("seed") != "", 0.0))
    pattern = F.array(
        F.struct(F.lit("l").alias("side"), F.col("l2").alias("p")), F.struct(F.lit("m").alias("side"), F.col("m2").alias("p")), F.struct(F.lit("r").alias("side"), F.col("r2").alias("p")),
        F.struct(F.lit("s").alias("side"), F.col("shape").alias("p")),
    )
    cued = graph.groupBy("class", "kind", "shape").agg((F.sum(F.when(F.col("label") == 1.0, F.col("n")).otherwise(0)) / F.sum("n")).alias("cued"))
    graph = materialize(graph.join(cued, ["class", "kind", "shape"]), "pii-graph")
    belief = graph.withColumn("score", F.coalesce("label", F.lit(0.0)))
    believed = -1
    for _ in range(rounds):
        edges = belief.select("class", "kind", "n", "score", F.explode(pattern).alias("x")).select("class", "kind", "n", "score", "x.side", "x.p")
        # shapes of persons say nothing, nor do patterns without a word; half a doubt for each pattern keeps rare ones below common ones
        quality = edges.where("NOT (class = 'PERSON' AND side = 's')").where((F.col("side") == "s") | F.regexp_replace("p", "_", "").rlike(r"\p{L}")).groupBy("class", "kind", "side", "p").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 0.5)).alias("q"))
        quality = quality.where(F.col("q") >= 0.02)
        out = graph
        for side, col in (("l", "l2"), ("m", "m2"), ("r", "r2"), ("s", "shape")):
            q = quality.where(F.col("side") == side).select("class", "kind", F.col("p").alias(col), F.col("q").alias(f"q_{side}"))
            out = out.join(q, ["class", "kind", col], "left")
        context = F.greatest(*[F.coalesce(F.col(f"q_{s}"), F.lit(0.0)) for s in "lmr"])
        # a shape that never follows a cue is believed in no context
        numeric = F.when(F.coalesce("cued", F.lit(0.0)) >= 0.02, 1 - (1 - context) * (1 - F.coalesce("q_s", F.lit(0.0)))).otherwise(F.least(context, F.lit(0.4)))
        score = F.when(F.col("class") == "PERSON", context).otherwise(numeric)
        belief = materialize(out.select(*node, "seed", "n", "kind", "label", F.coalesce("label", score).alias("score"), score.alias("open")), "pii-belief")
        now = belief.where(F.col("open") >= threshold).count()
        if now == believed:
            break
        believed = now
    final = belief.withColumn("open", F.greatest("open", F.coalesce("label", F.lit(0.0)) * 0.6))
    best = final.groupBy(*node, "seed").agg(F.max(F.struct("open", "kind")).alias("x")).select(*node, "seed", F.col("x.open").alias("score"), F.col("x.kind").alias("kind")).where(F.col("score") >= threshold)
    hits = cands.where("class <> 'EMAIL'").join(best, [*node, "seed"]).select("key", F.col("kind").alias("pii_type"), "start_at", "end_at", "score", (F.col("seed") != "").alias("seeded"), ((F.col("shape") == "GIF") & (F.col("seed") == "")).alias("odd"))
    mails = cands.where("class = 'EMAIL'").select("key", F.lit("EMAIL").alias("pii_type"), "start_at", "end_at", F.lit(1.0).alias("score"), F.lit(True).alias("seeded"), F.lit(False).alias("odd"))
    # overlaps: the better context (a doubt for an unknown word before an initial), then seeds, then the longer; a window over one text's findings
    allof = hits.unionByName(mails).withColumn("rank", F.struct(F.round(F.col("score") - F.when(F.col("odd"), 0.2).otherwise(0.0), 1).alias("a"), F.col("seeded").cast("int").alias("b"), (F.col("end_at") - F.col("start_at")).alias("c"), (-F.col("start_at")).alias("d")))
    # findings that overlap, directly or through others, form a chain; each is held against all of its chain
    order = W.partitionBy("key").orderBy("start_at", "end_at")
    reach = F.max("end_at").over(order.rowsBetween(W.unboundedPreceding, -1))
    chained = allof.withColumn("opens", F.when(reach.isNull() | (F.col("start_at") >= reach), 1).otherwise(0)).withColumn("chain", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rivals = chained.withColumn("near", F.collect_list(F.struct("start_at", "end_at", "rank")).over(W.partitionBy("key", "chain")))
    wins = F.forall("near", lambda o: (o["end_at"] <= F.col("start_at")) | (o["start_at"] >= F.col("end_at")) | (o["rank"] <= F.col("rank")))
    return rivals.where(wins).select("key", "pii_type", "start_at", "end_at", "score")


def redact(df: DataFrame, findings: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, text) with every finding replaced by ``[TYPE]``; texts without findings stay as they are."""
    one = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL").groupBy("key").agg(F.max("text").alias("text"))
    spans = findings.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "pii_type"))).alias("spans"))
    d = one.join(spans, "key", "left")
    # text before each finding, its placeholder, then the rest
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    step = lambda acc, s: F.struct(
        s["end_at"].alias("at"), F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start_at"] - acc["at"]).cast("int")), F.lit("["), s["pii_type"], F.lit("]")).alias("done"),
    )
    out = F.aggregate("spans", start, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return d.select(F.col("key").alias(key), F.when(F.col("spans").isNull(), F.col("text")).otherwise(out).alias(text))
