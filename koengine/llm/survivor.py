"""Best representative of each duplicate group: consistent bundles, chosen by branch and bound.

Fields that depend on each other form a bundle and survive together from one row; independent
fields are bundles of one. Each bundle's candidates are reduced to the most trusted one for each
distinct value before anything is gathered, then to the most trusted one for each distinct value of
the fields that a functional dependency ties to another bundle: of candidates alike in these the
others can never be in a best choice. A bundle without ties keeps one. What is left is searched by
depth-first branch and bound, best first, maximising the summed trust under the dependencies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from koengine.runtime import ship_code

#: Values that stand for "not known", compared without case, spaces and dots.
STAND_INS = ("", "-", "--", "---", "?", "??", "n/a", "na", "ka", "keineangabe", "none", "null", "nil", "tbd", "tba", "unknown", "unbekannt", "inconnu", "desconocido", "notstated", "notknown", "notavailable", "notprovided", "missing", "undefined", "s/o", "nd", "n/d", "xxx")


_NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def value_key(c: Column) -> Column:
    """A value apart from case and spaces."""
    return F.regexp_replace(F.lower(c), r"[\s\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]+", "")


def usable(c: Column) -> Column:
    """Not null, not blank, no stand-in, not visibly cut off (an ellipsis at its end)."""
    key = value_key(c)
    bare = F.regexp_replace(key, r"[.()\[\]]", "")
    return F.coalesce(c.isNotNull() & (key != "") & ~bare.isin(*STAND_INS) & ~key.rlike(r"(\.\.+|…)[\"'”)\]]?$"), F.lit(False))


def choose_bundles(cands: Sequence[Sequence[tuple]], ties: Sequence[tuple[int, int, int, int]]) -> list[int]:
    """Indexes of the chosen candidate of each bundle: greatest summed trust that breaks no tie.

    ``cands[b]`` lists (trust, values) by falling trust. A tie (b1, i, b2, j) says that value i of
    bundle b1 determines value j of bundle b2 (both null-safe equal once used together). -1 leaves a
    bundle empty, at trust 0, so a choice always exists.
    """
    n = len(cands)
    best_rest = [0.0] * (n + 1)
    for b in range(n - 1, -1, -1):
        best_rest[b] = best_rest[b + 1] + (cands[b][0][0] if cands[b] else 0.0)
    best: list = [-1.0, [-1] * n]

    def consistent(b: int, pick: list[int]) -> bool:
        for b1, i, b2, j in ties:
            if max(b1, b2) == b and pick[b1] >= 0 and pick[b2] >= 0 and cands[b1][pick[b1]][1][i] != cands[b2][pick[b2]][1][j]:
                return False
        return True

    def go(b: int, trust: float, pick: list[int]) -> None:
        if trust + best_rest[b] <= best[0]:
            return
        if b == n:
            best[0], best[1] = trust, pick + [-1] * (n - len(pick))
            return
        for k, (t, _) in enumerate(cands[b]):
            pick.append(k)
            if consistent(b, pick):
                go(b + 1, trust + t, pick)
            pick.pop()
        pick.append(-1)
        go(b + 1, trust, pick)
        pick.pop()

    go(0, 0.0, [])
    return best[1]


def survivors(
    df: DataFrame, *, group: Sequence[str], key: str, bundles: Sequence[Sequence[str]], trust: Sequence[Column], dependencies: Sequence[tuple[str, str]] = (), min_rows: int = 2,
) -> DataFrame:
    """(group..., bundle, field_name, key, value) of the surviving values of each group.

    ``trust`` are columns compared in order (greater is better, null least); where a dependency makes
    bundles compete, the sum of the first (as a number above 0) decides. Of the rows of a group
    that hold the winning bundle value apart from case and spaces, the smallest key is given. A
    bundle's row is a candidate if at least one of its fields is usable; a field that is not usable
    does not survive. ``dependencies`` are pairs of fields of different bundles that must agree
    (apart from case and spaces) in the surviving record.

    Defined cases: rows with a null group column or key take no part; a key counts once, repeated
    rows change nothing; groups of fewer than ``min_rows`` keys give no rows; a group without any
    usable value gives no rows; further columns are ignored.
    """
    spark = df.sparkSession
    ship_code(spark)
    fields = [f for b in bundles for f in b]
    where = {f: (bi, fi) for bi, b in enumerate(bundles) for fi, f in enumerate(b)}
    ties = [(*where[a], *where[b]) for a, b in dependencies]
    tied = {t[0] for t in ties} | {t[2] for t in ties}
    g = list(group)
    rows = df.select(*g, F.col(key).alias("key_"), F.struct(*[c.alias(f"t{i}") for i, c in enumerate(trust)]).alias("trust_"), *[F.col(f).cast("string").alias(f) for f in fields])
    for c in [*g, "key_"]:
        rows = rows.where(F.col(c).isNotNull())
    # one row a bundle, field values made comparable
    packed = F.array(*[
        F.struct(F.lit(i).alias("bundle"), F.array(*[F.when(usable(F.col(f)), value_key(F.col(f))) for f in b]).alias("same"), F.array(*[F.when(usable(F.col(f)), F.col(f)) for f in b]).alias("vals"))
        for i, b in enumerate(bundles)
    ])
    each = rows.select(*g, "key_", "trust_", F.explode(packed).alias("x")).select(*g, "key_", "trust_", "x.*")
    # group size counts keys, not rows; two levels, so one hot group is reduced map-side
    sizes = rows.groupBy(*g).agg(F.min("key_").alias("lo"), F.max("key_").alias("hi"))
    big = sizes.where("lo <> hi").select(*g) if min_rows == 2 else rows.select(*g, "key_").distinct().groupBy(*g).count().where(F.col("count") >= min_rows).select(*g)
    cand = each.where(F.exists("same", lambda v: v.isNotNull()))
    cand = cand.groupBy(*g, "bundle", "same").agg(F.max("trust_").alias("trust_"), F.min(F.struct("key_", "vals")).alias("x")).select(*g, "bundle", "same", "trust_", "x.*")
    none = F.array().cast("array<string>")
    tie_values = none
    for b in sorted(tied):
        at = sorted({t[1] for t in ties if t[0] == b} | {t[3] for t in ties if t[2] == b})
        tie_values = F.when(F.col("bundle") == b, F.array(*[F.element_at("same", i + 1) for i in at])).otherwise(tie_values)
    best = cand.groupBy(*g, "bundle", tie_values.alias("tie_")).agg(F.max(F.struct("trust_", F.struct("same", "key_", "vals").alias("c"))).alias("x")).select(*g, "bundle", F.col("x.trust_").alias("trust_"), "x.c.*")
    best = best.join(big, g, "left_semi")
    # sorted by all trust columns; the search adds up the first, and equal sums go to the earlier place
    first = F.greatest(F.lit(1e-9), F.coalesce(F.col("trust_.t0").cast("double"), F.lit(0.0))) if trust and dict(rows.select("trust_.t0").dtypes)["t0"] in _NUMBERS else F.lit(1.0)
    best = best.withColumn("weight_", first)
    entries = F.sort_array(F.collect_list(F.struct("trust_", "bundle", "same", "key_", "vals", "weight_")), asc=False)
    packs = best.groupBy(*g).agg(F.transform(entries, lambda e: F.struct(e["bundle"].alias("bundle"), e["same"].alias("same"), e["key_"].alias("key_"), e["vals"].alias("vals"), e["weight_"].alias("weight_"))).alias("cands"))
    n = len(bundles)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for cands in s:
                by: list[list] = [[] for _ in range(n)]
                at: list[list[int]] = [[] for _ in range(n)]
                for i, c in enumerate(cands):
                    by[c["bundle"]].append((float(c["weight_"]), list(c["same"])))
                    at[c["bundle"]].append(i)
                chosen = choose_bundles(by, ties)
                out.append([at[b][k] for b, k in enumerate(chosen) if k >= 0])
            yield pd.Series(out, dtype=object)

    won = packs.withColumn("at", pick("cands")).select(*g, F.explode("at").alias("i"), "cands").select(*g, F.element_at("cands", F.col("i") + 1).alias("c"))
    names = F.array(*[F.array(*[F.lit(f) for f in b]) for b in bundles])
    out = won.select(*g, F.col("c.bundle").alias("bundle"), F.col("c.key_").alias("key_"), F.explode(F.arrays_zip(F.element_at(names, F.col("c.bundle") + 1).alias("f"), F.col("c.vals").alias("v"))).alias("z"))
    return out.where("z.v IS NOT NULL").select(*g, "bundle", F.col("z.f").alias("field_name"), F.col("key_").alias(key), F.col("z.v").alias("value"))
