"""Template residue and error-page text: recurrent lines are subtracted, what is left is judged.

Lines are normalised and counted by host (here the document's collection). Headings and fragments
that recur over several hosts are boilerplate (navigation, footers) and are subtracted. A document
is rejected if its own text holds an unfilled template slot, or if all that remains of it is
evidence of filler, an error page or a notice that scripts, cookies or a browser check are needed.
Evidence is learned: seed words give lines a first score, and the words of the lines that stand
beside them on pages without content, weighed by the number of hosts that use a line, are set
against the words of ordinary lines (:func:`score_lines`). Code, quotations and sentences about
such things are no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from koengine.runtime import materialize, spread

_NAME = r"[\p{L}_][\p{L}\p{N}_. -]{0,40}"
#: Slot forms of common template languages.
SLOTS = "|".join((
    r"\{\{\{?\s*" + _NAME + r"\s*\}\}\}?",
    r"\$\{\s*" + _NAME + r"\s*\}",
    r"#\{\s*" + _NAME + r"\s*\}",
    r"<%=?\s*" + _NAME + r"\s*%>",
    r"\{%\s*" + _NAME + r"\s*%\}",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"<<\s*" + _NAME + r"\s*>>",
    r"@@\w{2,40}@@",
    r"(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)",
    r"(?<![\w%])%[A-Z][A-Z_]{1,40}%(?![\w%])",
    r"(?<![\w$])\$[A-Z][A-Z_]{1,40}\$(?![\w$])",
    r"«[\p{L}_]{2,40}»",
    r"&lt;\s*" + _NAME + r"\s*&gt;",
    r"(?i:<(?:insert|enter|your|add) [^<>\n]{1,40}>)",
    r"(?<![\w<&])<(?:[A-Z][A-Z_]{2,40}|[a-z]+(?:_[a-z]+)*)>(?!\w)",
    r"(?i:\[(?:todo|tbd|insert|your|enter|add|fill in)\b[^\[\]\n]{0,60}\])",
    r"(?i:\[[^\[\]\n]{1,40} (?:goes|comes) here\])",
    r"(?<![\w$#{%\\])\{[a-z][a-z_]{1,40}\}(?![\w}])",
))
#: Without one of these a line holds no slot.
_OPENERS = r"[{<«%]|\[[\[\p{L}]|@@|\$[A-Z]|__|&lt;"
_TAGS = r"</?(?:html|head|body|div|span|p|b|i|u|em|strong|br|hr|h[1-6]|ul|ol|li|table|tr|td|th|a|pre|code|center|title|script|style|img|noscript|main|nav|footer|header)\b[^<>]*>"
_CODE_LINE = r"^\s*(?://|///|#!|\$ |let |fn |pub |use |impl |struct |return |if .*\{\s*$|for .*\{\s*$|import |export |assert|println!|[\w.]+\(.*\);?\s*$)|(?:;|;\s*\}|\{|=>)\s*$|^\s*[})\];]+\s*$"
_EXPLAINS = r"(?i)\b(?:templates? (?:use|uses|engine)|syntax|placeholders? (?:is|are|such|like)|the (?:braces|renderer)|is filled at|are literal)\b"



# Words of error pages, notices that scripts are needed, and filler, in five languages; the seeds of the evidence.
# Strong words speak for a page without content by themselves, weak ones only beside others.
STRONG = frozenset(
    "error errors unavailable forbidden unauthorized denied expired timeout offline oops javascript cookie cookies captcha robot noscript scripts scripting browser gateway placeholder dummy lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore aliqua veniam nostrud laboris commodo velit cillum fugiat pariatur excepteur cupidatat proident mollit laborum blindtext platzhaltertext "
    "fehler wartung verweigert skripte erreur introuvable refusé provisoire indisponible acceso denegado relleno mantenimiento エラー スクリプト クッキー アクセス #code #json #request #repeat".split()
)
WEAK = frozenset(
    "found gone time answer respond back available longer rendered unhandled server service internal bad unknown unexpected fault failed failure exception connection upstream backend proxy host timed reset request requests resource page document site website account session limit maintenance "
    "script enable enabled disabled activate allow allowed turn block blocked blocker verify human checking required requires needs supported please try again later retry reload refresh contact administrator sign moved deleted removed missing mistyped address link loading "
    "sample filler content text copy description type goes here replace bitte aktivieren erneut versuchen seite dienst später anmelden ihr faux texte maquette veuillez activer réessayer page remplacer service ici página error servidor active activar intente vuelva inicie sesión texto contenido ejemplo aquí ページ 見 仮".split()
)
#: What a word can take from a line at most; a sentence holds many that evidence lacks.
LOWEST = -1.5
#: Stands in every line, so its count is the number of lines.
LINE = "#line"
QUOTED = "[\"“„«][^\"“”»]*[\"”“»]"
_HTTP = r"(?i:^\W*(?:(?:http(?:/[\d.]+)?|error|status|code|erreur|fehler)\W*)?[45]\d\d\b)"
_REQUEST = r"\b(?:GET|POST|PUT|DELETE|HEAD|PATCH) /\S*"
_ANSWER = r"(?i)^\s*\{\s*\"(?:status|error|errors|code|message|detail|title)\"\s*:.*\}\s*$"
#: Runs of letters of one script, or single letters of scripts without spaces.
_TOKEN = r"[\p{IsHan}\p{IsHiragana}]|[\p{IsKatakana}ー]+|[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]+"


def _own_text(text: Column) -> Column:
    """Text without fenced and inline code."""
    t = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", "\n")
    return F.regexp_replace(t, r"`[^`\n]*`", " ")


def _lines(text: Column) -> Column:
    return F.split(text, r"[\r\n\x{85}\x{2028}\x{2029}]+")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space collapsed, trimmed of marks and tags."""
    x = F.lower(line)
    x = F.when(x.contains("<"), F.regexp_replace(x, _TAGS, " ")).otherwise(x)
    x = F.regexp_replace(x, r"\d+", "0")
    x = F.regexp_replace(x, r"[\s\x{A0}\x{2000}-\x{200B}\x{3000}]+", " ")
    return F.trim(x)


def has_slot(text: Column) -> Column:
    """An unfilled slot in a line that is neither code nor an explanation of template syntax."""

    def open_slot(line: Column) -> Column:
        bare = F.when(line.contains("<"), F.regexp_replace(line, _TAGS, " ")).otherwise(line)
        return line.rlike(_OPENERS) & bare.rlike(SLOTS) & ~line.rlike(_EXPLAINS) & ~line.rlike(_CODE_LINE)

    # the cheap test first: most texts hold none of the characters that open a slot
    own = _own_text(text)
    return F.when(text.rlike(_OPENERS), F.exists(_lines(own), open_slot)).otherwise(False)


def _plain(line: Column) -> Column:
    """A raw line without what stands in quotation marks (an answer in JSON keeps it) and without tags."""
    out = F.when(line.rlike("[\"“„«]") & ~line.rlike(_ANSWER), F.regexp_replace(line, QUOTED, " ")).otherwise(line)
    return F.when(line.contains("<"), F.regexp_replace(out, _TAGS, " ")).otherwise(out)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _with_marks(line: Column, plain: Column, words: Column) -> Column:
    """Distinct words, and marks for what is no word: a status code that opens the line, an answer in JSON, a request, words repeated over and over."""
    # four words or more, half of them repeated
    again = (F.size(words) >= 4) & (F.size(F.array_distinct(words)) * 2 <= F.size(words))
    marks = F.array(F.when(plain.rlike(_HTTP), "#code"), F.when(line.rlike(_ANSWER), "#json"), F.when(plain.rlike(_REQUEST), "#request"), F.when(again, "#repeat"))
    return F.concat(F.array_distinct(words), F.filter(marks, lambda m: m.isNotNull()))


def lines_with_words(lines: Column) -> Column:
    """(line, words) of each line: step by step, so that nothing is computed twice."""
    plain = F.transform(lines, lambda x: F.struct(x.alias("line"), _plain(x).alias("plain")))
    cut = F.transform(plain, lambda s: F.struct(s["line"].alias("line"), s["plain"].alias("plain"), _words(s["plain"]).alias("words")))
    return F.transform(cut, lambda s: F.struct(s["line"].alias("line"), _with_marks(s["line"], s["plain"], s["words"]).alias("words")))


def _prior(word: Column) -> Column:
    return F.when(word == LINE, 0.0).when(word.isin(*STRONG), 2.5).when(word.isin(*WEAK), 1.0).when(F.length(word) == 1, -0.1).otherwise(-0.35)


def seeded(words: Column) -> Column:
    """A line that may be evidence by its seeds: a strong word or two weak ones, and not many others."""
    worth = F.aggregate(words, F.lit(0.0), lambda s, w: s + _prior(w))
    strong, weak = F.exists(words, lambda w: w.isin(*STRONG)), F.size(F.filter(words, lambda w: w.isin(*WEAK))) >= 2
    return (strong | weak) & (worth >= -1.0)


def score_lines(lines: DataFrame, own: DataFrame, ordinary: DataFrame, *, rounds: int = 3, weight: float = 8.0, least: float = 1.0) -> DataFrame:
    """(h, score) of every distinct line (h, words): how far its words speak for a page without content.

    A word starts with its seed value and moves to the log-odds of its counts in evidence against
    ordinary lines, the more the oftener it is seen (``weight`` sightings make half). Lines are
    evidence in a round if they score ``least`` (0 in the first) and stand in documents (``own``: key, h, size) that
    consist of such lines to a third or more; recurring over hosts counts, as each host's use of a line is one
    sighting (``uses``). All other lines are ordinary, and so is ``ordinary`` (word, n: counts in all
    texts without a seed). Words that stand beside known ones on many hosts' error pages are so
    learned, and words that ordinary text uses lose their value.
    """
    each = materialize(lines.select("h", "uses", F.explode(F.array_append(F.array_distinct("words"), LINE)).alias("word")), "residue-words")
    value = each.select("word").distinct().withColumn("value", _prior(F.col("word")))
    score = None
    for i in range(rounds):
        score = materialize(each.join(value, "word").groupBy("h").agg(F.sum("value").alias("score"), F.max("uses").alias("uses")), "residue-scores")
        if i == rounds - 1:
            break
        shell = own.join(score.select("h", (F.col("score") >= (least if i else 0.0)).alias("on")), "h", "left").groupBy("key").agg((F.sum(F.when(F.col("on"), F.col("size")).otherwise(0)) * 3 >= F.sum("size")).alias("shell"))
        # in a page of which a third is evidence the rest is evidence too; elsewhere nothing is
        placed = own.join(shell, "key").groupBy("h").agg((F.avg(F.col("shell").cast("int")) >= 0.5).alias("evidence"))
        seen = each.join(placed, "h").groupBy("word").agg(F.sum(F.when(F.col("evidence"), F.col("uses")).otherwise(0)).alias("e"), F.sum(F.when(~F.col("evidence"), F.col("uses")).otherwise(0)).alias("c"))
        seen = seen.join(ordinary, "word", "left").select("word", "e", (F.col("c") + F.coalesce("n", F.lit(0))).alias("c"))
        total = seen.where(F.col("word") == LINE).select(F.col("e").alias("te"), F.col("c").alias("tc"))
        # each side is smoothed by one line of the word's overall rate, so a word unseen on one side speaks for the other
        rate = (F.col("e") + F.col("c")) / (F.col("te") + F.col("tc"))
        odds = F.log((F.col("e") + rate) / (F.col("te") + 1.0)) - F.log((F.col("c") + rate) / (F.col("tc") + 1.0))
        trust = (F.col("e") + F.col("c")) / (F.col("e") + F.col("c") + weight)
        learned = seen.crossJoin(F.broadcast(total))  # a single row
        value = materialize(learned.select("word", F.when(F.col("word") == LINE, 0.0).otherwise(trust * F.greatest(F.lit(LOWEST), F.least(F.lit(3.0), odds)) + (1 - trust) * _prior(F.col("word"))).alias("value")), "residue-values")
    return score.select("h", "score")


def find_residue(df: DataFrame, *, key: str, text: str, host: str, min_hosts: int = 3, min_lines: int = 5, max_content: float = 0.25, least: float = 1.0) -> DataFrame:
    """(key, reason) of every document to exclude; reason is 'slot' or 'empty_of_content'.

    A line is boilerplate, and subtracted, if it is a heading, a fragment of four words at most, or
    any fragment without a sentence's end that occurs at least ``min_lines`` times over at least ``min_hosts`` hosts. A document without
    slots is excluded if its residual holds evidence (a line that scores ``least``, see
    :func:`score_lines`) and lines of content make up at most ``max_content`` of its characters. The
    words of ordinary text are counted in every document without a seed, as lines, hosts and
    decisions cover every document.

    Defined cases: null and blank texts are no case; a null host counts as a host of its own; very
    long texts and lines are read whole; repeated texts are judged alike; repeated keys give one
    row; further columns are ignored.
    """
    d = df.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    own_text = F.when(F.col("text").contains("`"), _own_text(F.col("text"))).otherwise(F.col("text"))

    def fact(s: Column) -> Column:
        x = s["x"]
        ends = x.rlike(r"[.!?。;}]$")
        few = F.size(F.split(F.trim(F.regexp_replace(x, r"^[#>*•\-\s]+", "")), r"\s+")) <= 4
        return F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("size"), (x.startswith("#") | (~ends & few)).alias("short"), (~ends).alias("fragment"))

    # every text is read once; the lines of documents with a seed keep their words, of the others hashes and sizes,
    # whose words are counted as ordinary text (a column of its own, so that only the count reads it)
    read = spread(d).select("key", "host", "text", own_text.alias("own"))
    read = read.select("key", "host", has_slot(F.col("text")).alias("slot"), F.filter(_lines(F.col("own")), lambda x: x.rlike(r"\S")).alias("raw"))
    read = read.select("key", "host", "slot", F.transform("raw", lambda x: F.struct(normal_line(x).alias("x"))).alias("norm"), F.transform(lines_with_words(F.col("raw")), lambda s: s["words"]).alias("words"))
    read = read.select("key", "host", "slot", F.exists("words", seeded).alias("seeded"), F.transform("norm", fact).alias("facts"), "words")
    read = read.select("key", "host", "slot", "seeded", "facts", F.when(F.col("seeded"), F.col("words")).alias("words"), F.when(~F.col("seeded"), F.flatten(F.transform("words", lambda w: F.array_append(w, LINE)))).alias("said"))
    none = F.array().cast("array<array<string>>")
    both = F.zip_with("facts", F.coalesce("words", none), lambda f, w: F.struct(f["h"].alias("h"), f["size"].alias("size"), f["short"].alias("short"), f["fragment"].alias("fragment"), w.alias("words")))
    read = materialize(read.select("key", "host", "slot", "seeded", F.filter(both, lambda f: f["size"] > 0).alias("lines"), "said"), "residue-lines")
    ordinary = materialize(read.select(F.explode("said").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "residue-ordinary")
    slots = read.where("slot").select("key", F.lit("slot").alias("reason"))
    # statistics over every line of every document: hash and host only, reduced before the shuffle
    seen = read.select("host", F.explode("lines.h").alias("h")).groupBy("h", "host").agg(F.count("*").alias("n"))
    counts = materialize(seen.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("hosts")), "residue-counts")
    every = read.where("NOT slot").select("key", "seeded", F.explode("lines").alias("x")).select("key", "seeded", "x.*")
    # a line that its seeds alone make evidence is no boilerplate
    seed = F.coalesce(F.exists("words", lambda w: w.isin(*STRONG)) & (F.aggregate("words", F.lit(0.0), lambda s, w: s + _prior(w)) >= 0), F.lit(False))
    boiler = ~seed & (F.col("short") | (F.coalesce(F.col("n") >= min_lines, F.lit(False)) & F.coalesce(F.col("hosts") >= min_hosts, F.lit(False)) & F.col("fragment")))
    own = every.where("seeded").join(counts, "h", "left")
    judged = own.withColumn("boiler", boiler)
    distinct = judged.groupBy("h").agg(F.first("words").alias("words"), F.max("hosts").alias("uses"))
    score = materialize(score_lines(distinct, judged.where(~F.col("boiler")).select("key", "h", "size"), ordinary, least=least), "residue-judged")
    # a document without a seed may still consist of lines that others taught
    known = score.where(F.col("score") >= least).select("h")
    some = every.where(~F.col("seeded")).join(known, "h", "left_semi").select("key").distinct()
    rest = every.where(~F.col("seeded")).join(some, "key", "left_semi").join(counts, "h", "left").withColumn("boiler", boiler)
    both = judged.select("key", "h", "size", "boiler").unionByName(rest.select("key", "h", "size", "boiler")).join(score, "h", "left")
    # evidence is never boilerplate
    evidence = F.coalesce(F.col("score") >= least, F.lit(False))
    content = ~evidence & ~F.col("boiler") & F.coalesce(F.col("score") < 0, F.lit(True))
    parts = both.groupBy("key").agg(F.sum(F.when(evidence, F.col("size")).otherwise(0)).alias("evidence"), F.sum(F.when(content, F.col("size")).otherwise(0)).alias("content"), F.sum(F.when(evidence | ~F.col("boiler"), F.col("size")).otherwise(0)).alias("left"))
    shells = parts.where((F.col("evidence") > 0) & (F.col("content") <= max_content * F.col("left")))
    return slots.unionByName(shells.select("key", F.lit("empty_of_content").alias("reason"))).groupBy("key").agg(F.max("reason").alias("reason")).select(F.col("key").alias(key), "reason")
