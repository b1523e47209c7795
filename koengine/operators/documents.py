"""Documents to knowledge: lines, blocks, sections, entities, dates, relations, chunks. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from koengine.functions.text import DEONTIC, dates_in, date_range, suspicious

BLANK_LINE = r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"


def text_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_number, line) of every line that is not blank; blank lines count."""
    d = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\r?\n")).alias("i", "line"))
    return d.where(F.col("line").rlike(r"\S")).select(key, (F.col("i") + 1).alias("line_number"), "line")


def html_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags go, common entities become characters."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, BLANK_LINE), F.trim), lambda p: p != "")


def block_type(block: Column) -> Column:
    """Code, List, Figure, Heading, Table or Paragraph; the first rule that fits."""
    lines = F.split(block, "\n")
    n = F.size(lines)
    code = (n >= 2) & F.forall(lines, lambda x: x.startswith("    ") | x.startswith("\t"))
    item = lambda x: x.rlike(r"^\s*(?:[-*•+]|\d+[.)]|\d+ -|[A-Za-z][.)]) ")
    single_number = (n == 1) & block.rlike(r"^\s*(?:\d+[.)]|[A-Za-z][.)])")
    listed = F.forall(lines, item) & ~single_number
    figure = block.rlike(r"^\s*(?:Figure |Fig\. |Fig )")
    letters = F.length(F.regexp_replace(block, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(block, r"[^\p{Lu}]", ""))
    short = (n == 1) & (F.octet_length(block) <= 120) & ~block.rlike(r"[.,;]\s*$")
    heading = block.rlike(r"^#{1,6} ") | ((n == 1) & (block.rlike(r"^\s*[0-9.]{2,} ") & (F.octet_length(block) < 150) | block.rlike(r"^\s*(?:Chapter|Part|Appendix|Section) "))) | (short & ((upper > 0.8 * letters) | (F.octet_length(block) <= 80)))
    table = (n >= 2) & F.forall(lines, lambda x: x.contains("|"))
    return F.when(code, "Code").when(listed, "List").when(figure, "Figure").when(heading, "Heading").when(table, "Table").otherwise("Paragraph")


def heading_level(block: Column) -> Column:
    marks = F.length(F.regexp_extract(block, r"^(#{1,6}) ", 1))
    dots = F.length(F.regexp_replace(F.regexp_extract(block, r"^\s*([0-9.]{2,}) ", 1), r"[^.]", ""))
    return F.when(marks > 0, marks).when(dots > 0, F.least(dots, F.lit(3))).when(block.rlike(r"^\s*(?:Chapter|Part|Appendix) "), 1).otherwise(2)


def blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block_no, block_type, heading_level, block)."""
    raw = F.filter(F.split(F.col(text), BLANK_LINE), lambda p: p.rlike(r"\S"))
    d = df.select(F.col(key), F.posexplode(raw).alias("i", "block")).withColumn("block_type", block_type(F.col("block")))
    return d.select(key, (F.col("i") + 1).alias("block_no"), "block_type", F.when(F.col("block_type") == "Heading", heading_level(F.col("block"))).alias("heading_level"), "block")


def section_kind(heading: Column, level: Column, body: Column) -> Column:
    """Artifact, Rule, Instruction, Decision, Entity or Claim of a Markdown section; the first that fits."""
    low = F.lower(heading)
    imperative = r"(?i)^(?:add|build|call|check|create|delete|deploy|enable|ensure|install|open|read|remove|restart|run|set|start|stop|test|update|use|verify|write)\b"
    return (
        F.when(body.rlike(r"(?m)^```\w"), "Artifact").when(body.rlike(r"(?m)^\s*[-*] ") & body.rlike(DEONTIC), "Rule")
        .when(body.rlike(imperative), "Instruction").when(low.rlike("adr|architecture decision|decision record|^#* *decision"), "Decision")
        .when(low.rlike("architecture|component|module|service|overview|introduction|project|repository|database|api|design"), "Entity").when(level <= 1, "Entity").otherwise("Claim")
    )


def entity_runs(text: Column) -> Column:
    """Two- and three-word windows over runs of capitalised words, longer than four characters, once each."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)+)"), F.lit(1))

    def windows(run: Column, n: int) -> Column:
        w = F.split(run, " ")
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    both = F.concat(F.flatten(F.transform(runs, lambda r: windows(r, 2))), F.flatten(F.transform(runs, lambda r: windows(r, 3))))
    return F.array_distinct(F.filter(both, lambda e: F.length(e) > 4))


def entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(F.col(key), F.explode(entity_runs(F.col(text))).alias("entity")).distinct()


def temporal_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    d = df.select(F.col(key), F.explode(F.array_distinct(dates_in(F.col(text)))).alias("date_text"))
    begin, end = date_range(F.col("date_text"))
    return d.select(key, "date_text", begin.alias("start_date"), end.alias("end_date"))


def cooccurrence(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, subject, object) of entities named in one paragraph, in order of mention, once a document. Pairs stay within their paragraph."""
    p = df.select(F.col(key), F.explode(paragraphs(F.col(text))).alias("p")).select(key, entity_runs(F.col("p")).alias("es")).where(F.size("es") >= 2)
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice("es", i + 2, F.greatest(F.size("es") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    return p.select(key, F.explode(pairs).alias("x")).select(key, "x.subject", "x.object").distinct()


def chunks(df: DataFrame, key: str, text: str = "text", most: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, chunk, char_count): paragraphs packed greedily up to ``most`` characters, with overlap in characters.

    A paragraph above the limit stands alone, cut at the limit.
    """
    parts = F.flatten(F.transform(paragraphs(F.col(text)), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + 2 + F.length(p) <= most)
        longer = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        # the tail of the chunk before opens the next, if both fit
        tail = F.right(acc["now"], F.lit(overlap))
        opened = F.when(F.length(p) + 1 + F.length(tail) <= most, F.concat(tail, F.lit("\n"), p)).otherwise(p)
        return F.when(fits, F.struct(acc["done"].alias("done"), longer.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), opened.alias("now")))

    packed = F.aggregate(parts, empty, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    d = df.select(F.col(key), F.posexplode(packed).alias("chunk_index", "chunk"))
    return d.select(key, "chunk_index", "chunk", F.length("chunk").alias("char_count"))


def links(text: Column) -> Column:
    """Targets of Markdown links and wiki links."""
    md = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]+\]\(([^)\s]+)\)"), F.lit(1))
    return F.array_distinct(F.concat(md, F.regexp_extract_all(text, F.lit(r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]"), F.lit(1))))


def trust(text: Column) -> Column:
    return F.when(suspicious(text), "Untrusted").otherwise("Trusted")


def page_needs_ocr(text: Column, threshold: int = 50) -> Column:
    return F.length(F.coalesce(F.trim(text), F.lit(""))) < threshold
