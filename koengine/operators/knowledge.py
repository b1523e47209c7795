"""Analytics over extracted knowledge: resolution, commit plans, merging, conflicts, staleness, impact, context, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from koengine.functions.text import name_similarity, normalize_name, tokens


def _scored(n: DataFrame, k: DataFrame, least: float) -> DataFrame:
    """(name, koid, kb_name, score) of the pairs of names (name) and entries' spellings (koid, kb_name) that score ``least``."""

    def grams(c: Column) -> Column:
        low = F.lower(c)
        # one and two letters meet short names only, which are as long as that
        cut = lambda m: F.transform(F.sequence(F.lit(1), F.length(low) - (m - 1)), lambda i: F.substring(low, i, m))
        each = [F.when(F.length(low) >= m, cut(m)).otherwise(F.array().cast("array<string>")) for m in (1, 2, 3)]
        return F.array_distinct(F.concat(*each))

    first = lambda c: F.substring(F.lower(c), 1, 3)
    by_token = n.select("name", F.explode(tokens(F.col("name"))).alias("t")).join(k.select("koid", "kb_name", F.explode(tokens(F.col("kb_name"))).alias("t")), "t").select("name", "koid", "kb_name")
    inner = n.select("name", first(F.col("name")).alias("t")).join(k.select("koid", "kb_name", F.explode(grams(F.col("kb_name"))).alias("t")), "t").select("name", "koid", "kb_name")
    outer = n.select("name", F.explode(grams(F.col("name"))).alias("t")).join(k.select("koid", "kb_name", first(F.col("kb_name")).alias("t")), "t").select("name", "koid", "kb_name")
    return by_token.unionByName(inner).unionByName(outer).distinct().withColumn("score", F.round(name_similarity(F.col("name"), F.col("kb_name")), 6)).where(F.col("score") >= least)


def resolve(names: DataFrame, kb: DataFrame, least: float = 0.5, gap: float = 0.15) -> DataFrame:
    """(name, koid, score, status): matched, ambiguous (the runner-up is within ``gap``) or unmatched.

    ``names`` has (name), ``kb`` (koid, name). Every pair that can score at all shares a token or has
    one name inside the other, so candidates come from an equi-join on tokens and on substrings (the
    first three letters of one, or all of a shorter one, among the substrings of that length of the
    other): no pair is lost and none is compared in vain.
    """
    n = names.select("name").where("name IS NOT NULL").distinct()
    scored = _scored(n, kb.select("koid", F.col("name").alias("kb_name")).where("kb_name IS NOT NULL"), least)
    w = W.partitionBy("name").orderBy(F.desc("score"), "koid")
    two = scored.withColumn("r", F.row_number().over(w)).where("r <= 2")
    best = two.groupBy("name").agg(F.min_by("koid", "r").alias("koid"), F.max("score").alias("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    out = n.join(best, "name", "left")
    status = F.when(F.col("score").isNull(), "unmatched").when(F.col("second").isNotNull() & (F.round(F.col("score") - F.col("second"), 6) < gap), "ambiguous").otherwise("matched")
    return out.select("name", "koid", F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"))


def commit_actions(resolved: DataFrame, hints: DataFrame, kb: DataFrame) -> DataFrame:
    """(name, action): CreateKO, UpdateKO, NeedsReview (ambiguous, or the entry is of another type) or Skip (exact and nothing to add)."""
    r = resolved.join(hints, "name", "left").join(kb.select("koid", F.col("type_name")), "koid", "left")
    other = F.col("type_hint").isNotNull() & F.col("type_name").isNotNull() & (F.lower("type_hint") != F.lower("type_name"))
    action = F.when(F.col("status") == "ambiguous", "NeedsReview").when(F.col("status") == "unmatched", "CreateKO").when(other, "NeedsReview").when(F.col("score") == 1.0, "Skip").otherwise("UpdateKO")
    return r.select("name", action.alias("action"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """(document_id, key, name, type_hint, mentions, confidence): entities of one document and normalised name made one.

    Mentions are united, the least type hint that is there stays, confidences add up to 1 at most.
    """
    e = entities.withColumn("key", normalize_name(F.col("name"))).where("key <> ''")
    m = e.select("document_id", "key", F.explode_outer("mentions").alias("m")).where("m IS NOT NULL").distinct().groupBy("document_id", "key").agg(F.sort_array(F.collect_list("m")).alias("mentions"))
    one = e.groupBy("document_id", "key").agg(F.min("name").alias("name"), F.min("type_hint").alias("type_hint"), F.least(F.lit(1.0), F.round(F.sum(F.col("confidence").cast("double")), 4)).alias("confidence"))
    same = one["document_id"].eqNullSafe(m["document_id"]) & (one["key"] == m["key"])
    return one.join(m, same, "left").select(one["document_id"], one["key"], "name", "type_hint", F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"), "confidence")


def dedup_facts(facts: DataFrame) -> DataFrame:
    """(statement, document_id, confidence, copies): one row a statement, with its least document and highest confidence."""
    return facts.groupBy("statement").agg(F.min("document_id").alias("document_id"), F.max("confidence").alias("confidence"), F.count("*").alias("copies"))


def conflict_classes(facts: DataFrame) -> DataFrame:
    """(koid, property, value, documents, values): the values told of one property of one object, where there are several.

    Classes instead of pairs: each value is a row with its support, so a property with many values costs as many rows.
    """
    v = facts.groupBy("koid", "property", "value").agg(F.count_distinct("document_id").alias("documents"))
    n = v.groupBy("koid", "property").agg(F.count("*").alias("values")).where(F.col("values") > 1)
    return v.join(n, ["koid", "property"])


#: Words that oppose each other.
OPPOSED = (("must", "must not"), ("shall", "shall not"), ("should", "should not"), ("always", "never"), ("required", "optional"), ("enabled", "disabled"), ("sync", "async"))


def _word_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(entity, x, y, jaccard) of statements x of ``left`` and y of ``right`` that share a word under equal ``keys``."""
    side = lambda d, name: d.select(*keys, F.col("statement").alias(name), F.size("words").alias(f"n_{name}"), F.explode("words").alias("w"))
    both = side(left, "x").join(side(right, "y"), [*keys, "w"]).where("x <> y").groupBy(*keys, "x", "y", "n_x", "n_y").agg(F.count("*").alias("s"))
    return both.select("entity", "x", "y", (F.col("s") / (F.col("n_x") + F.col("n_y") - F.col("s"))).alias("jaccard"))


def statement_conflicts(facts: DataFrame) -> DataFrame:
    """(entity, a, b, kind) of two statements of one entity: opposed (``contradiction``; topics without the opposed words share more than 0.4) or nearly alike (``ambiguous``; 0.7 to 0.95).

    ``facts`` has (entity, statement). A statement of the negative word does not count as one of the
    positive word that lies in it. Pairs meet by shared words, so none that can score is left out.
    """
    f = facts.where("entity IS NOT NULL AND statement IS NOT NULL").select("entity", "statement").distinct()
    low = F.lower("statement")
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))
    sides = []
    for i, (yes, no) in enumerate(OPPOSED):
        rest = F.replace(low, F.lit(no), F.lit(""))
        sides += [F.when(rest.contains(yes), F.struct(F.lit(i).alias("pair"), F.lit(True).alias("yes"), words(F.replace(rest, F.lit(yes), F.lit(""))).alias("words")))]
        sides += [F.when(low.contains(no), F.struct(F.lit(i).alias("pair"), F.lit(False).alias("yes"), words(rest).alias("words")))]
    topics = f.select("entity", "statement", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("t")).select("entity", "statement", "t.*")
    against = _word_pairs(topics.where("yes"), topics.where(~F.col("yes")), ["entity", "pair"]).where("jaccard > 0.4")
    plain = f.withColumn("words", words(F.col("statement")))
    alike = _word_pairs(plain, plain, ["entity"]).where("jaccard > 0.7 AND jaccard < 0.95")
    ends = lambda d, kind: d.select("entity", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(kind).alias("kind"))
    return ends(against, "contradiction").unionByName(ends(alike, "ambiguous")).distinct()


#: Words that turn a statement round.
TURNS = ("not ", "no longer", "instead of", "rather than")


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of words between spaces; 0 if both are empty."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")), lambda w: w != "")
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def contradicts(a: Column, b: Column) -> Column:
    """One statement alone holds a turning word, or both say what something uses and name different things."""
    x, y = F.lower(a), F.lower(b)
    turned = F.lit(False)
    for t in TURNS:
        turned = turned | (x.contains(t) != y.contains(t))
    used = lambda c: F.trim(F.coalesce(F.try_element_at(F.split(c, "uses"), F.lit(2)), F.lit("")))
    return turned | ((used(x) != "") & (used(y) != "") & (used(x) != used(y)))


def staleness(facts: DataFrame) -> DataFrame:
    """(koid, property, value, status) of what is told of one property in several ways.

    ``facts`` has koid, property, value, confidence, at. The value of highest confidence (then latest,
    then least) is 'authoritative'; another is 'conflict' if it contradicts that one, else
    'divergence', and has no row if the two are equal but for case or share more than 0.85 of their
    words. Each value is held against the authoritative one, not against all: a property with many
    values costs as many rows. A property whose values all agree has no rows.
    """
    v = facts.groupBy("koid", "property", "value").agg(F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.col("at").alias("at"))).alias("t"))
    w = W.partitionBy("koid", "property").orderBy(F.desc("t"), "value")
    v = v.withColumn("r", F.row_number().over(w)).withColumn("best", F.first("value").over(w))
    alike = (F.lower("value") == F.lower("best")) | (word_jaccard(F.lower("value"), F.lower("best")) > 0.85)
    v = v.where((F.col("r") == 1) | ~F.coalesce(alike, F.lit(False))).withColumn("n", F.count("*").over(W.partitionBy("koid", "property")))
    status = F.when(F.col("r") == 1, "authoritative").when(contradicts(F.col("best"), F.col("value")), "conflict").otherwise("divergence")
    return v.where("n > 1").select("koid", "property", "value", status.alias("status"))


def impact(evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """(koid, severity): Direct if evidence lies in a changed document, Indirect if it shares a document with a direct one.

    ``evidence`` has (koid, document_id), ``changed`` (document_id).
    """
    e = evidence.where("koid IS NOT NULL AND document_id IS NOT NULL").distinct()
    direct = e.join(changed.distinct(), "document_id", "left_semi").select("koid").distinct()
    shared = e.join(direct, "koid", "left_semi").select("document_id").distinct()
    indirect = e.join(shared, "document_id", "left_semi").select("koid").distinct().join(direct, "koid", "left_anti")
    return direct.select("koid", F.lit("Direct").alias("severity")).unionByName(indirect.select("koid", F.lit("Indirect").alias("severity")))


def _begins(prefix: str):
    return lambda t: t.startswith(prefix)


def keyword_score(text: Column, words: list[str]) -> Column:
    """Sum over words of three letters or more: 1 if the text contains it, else 0.3 if a token begins with its first four letters."""
    low, toks = F.lower(text), tokens(text)
    total: Column = F.lit(0.0)
    for w in words:
        w = w.lower()
        if len(w) < 3:
            continue
        prefix = F.size(F.filter(toks, _begins(w[:4]))) > 0 if len(w) >= 4 else F.lit(False)
        total = total + F.when(low.contains(w), 1.0).when(prefix, 0.3).otherwise(0.0)
    return total


def rank_entities(entities: DataFrame, task: str) -> DataFrame:
    """(document_id, key, name, score) of the entities a task is about: name score plus half the mentions', raised by the number of mentions up to half."""
    words = task.split()
    mentions = F.aggregate("mentions", F.lit(0.0), lambda a, m: a + keyword_score(m, words))
    base = keyword_score(F.col("name"), words) + 0.5 * mentions
    return entities.withColumn("score", F.round(base * (1 + F.least(F.lit(0.1) * F.size("mentions"), F.lit(0.5))), 6)).where("score > 0").select("document_id", "key", "name", "score")


def pack_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The ranked rows that fit a token budget (a token is four bytes), up to the first that does not.

    Every row costs a token at least, so no more than ``budget`` rows can fit: the window runs over
    that many at most.
    """
    cost = F.ceil(F.octet_length("name") / 4).cast("long")
    few = ranked.withColumn("cost", F.greatest(cost, F.lit(1))).orderBy(F.desc("score"), F.coalesce("document_id", F.lit("")), "key").limit(budget)
    w = W.orderBy(F.desc("score"), F.coalesce("document_id", F.lit("")), "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    return few.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def recall(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(query_id, expected, hits, recall) of (query_id, id) lists."""
    hit = expected.join(got.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("expected"), F.count("hit").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("expected"), 6))


def lag_stats(lags: DataFrame, by: str, lag: str = "lag", p: float = 0.95) -> DataFrame:
    """(by, n, mean_lag, max_lag, p_lag): floored mean, maximum, and the value at floor((n - 1) * p) of the sorted list.

    The list is never built: equal lags are counted map-side, and the rank is found in the running
    count of distinct lags.
    """
    h = lags.where(F.col(lag).isNotNull()).groupBy(by, lag).agg(F.count("*").alias("c"))
    total = h.groupBy(by).agg(F.sum("c").alias("n"), F.floor(F.sum(F.col(lag) * F.col("c")) / F.sum("c")).alias("mean_lag"), F.max(lag).alias("max_lag"))
    run = h.withColumn("upto", F.sum("c").over(W.partitionBy(by).orderBy(lag)))
    at = run.join(total.select(F.col(by).alias("b_"), "n"), F.col(by).eqNullSafe(F.col("b_"))).where(F.col("upto") > F.floor((F.col("n") - 1) * p)).groupBy(by).agg(F.min(lag).alias("p_lag"))
    at = at.select(F.col(by).alias("a_"), "p_lag")
    return total.join(at, F.col(by).eqNullSafe(F.col("a_"))).select(by, "n", F.col("mean_lag").cast("long").alias("mean_lag"), F.col("max_lag").cast("long").alias("max_lag"), F.col("p_lag").cast("long").alias("p_lag"))


#: Type names that mean the same.
SAME_TYPES = (("company", "organization"), ("person", "individual"), ("location", "place"))


def types_match(a: Column, b: Column) -> Column:
    """Two type names fit: equal, one inside the other, or of one meaning; case is ignored and null fits nothing."""
    x, y = F.lower(a), F.lower(b)
    same = (x == y) | x.contains(y) | y.contains(x)
    for p, q in SAME_TYPES:
        same = same | ((x == p) & (y == q)) | ((x == q) & (y == p))
    return F.coalesce(same, F.lit(False))


def resolve_typed(names: DataFrame, kb: DataFrame, least: float = 0.5, gap: float = 0.15) -> DataFrame:
    """(name, type_hint, koid, score, status) as :func:`resolve`, over names and aliases, with the type in the decision.

    ``names`` has (name, type_hint), ``kb`` (koid, name, type_name, aliases). An entry scores by the best
    of its name and aliases; a hint that does not match the entry's type rules it out, no hint fits all.
    """
    spelled = kb.select("koid", "type_name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling")).where("spelling IS NOT NULL")
    n = names.select("name", "type_hint").where("name IS NOT NULL").distinct()
    scored = _scored(n.select("name").distinct(), spelled.select(F.col("koid"), F.col("spelling").alias("kb_name")), least).groupBy("name", "koid").agg(F.max("score").alias("score"))
    scored = n.join(scored, "name").join(kb.select("koid", "type_name"), "koid").where(F.col("type_hint").isNull() | types_match(F.col("type_hint"), F.col("type_name")))
    w = W.partitionBy("name", "type_hint").orderBy(F.desc("score"), "koid")
    two = scored.withColumn("r", F.row_number().over(w)).where("r <= 2")
    best = two.groupBy("name", "type_hint").agg(F.min_by("koid", "r").alias("koid"), F.max("score").alias("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    best = best.withColumnsRenamed({"name": "n_", "type_hint": "t_"})
    out = n.join(best, (n["name"] == best["n_"]) & n["type_hint"].eqNullSafe(best["t_"]), "left")
    status = F.when(F.col("score").isNull(), "unmatched").when(F.col("second").isNotNull() & (F.round(F.col("score") - F.col("second"), 6) < gap), "ambiguous").otherwise("matched")
    return out.select("name", "type_hint", "koid", F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"))
