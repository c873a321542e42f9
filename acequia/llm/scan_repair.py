"""Repair of text from scanned pages.

* Page numbers are lines of nothing else, in many notations. Running headers are lines that
  come back within a document once digits are masked and glyphs that scanners confuse are
  levelled; a line that continues a sentence isn't one.
* A word broken for the line end is told from a compound broken at its own hyphen by which
  of the two, joined or hyphenated, the whole corpus supports.
* Words are grouped by the skeleton of their glyphs (``rn`` and ``m``, ``0`` and ``o``,
  ``cl`` and ``d`` level out). In a group the form the corpus supports is right: a form is
  misread if another one is ``RATIO`` times as frequent, or as frequent after the same word
  before, or if it holds a glyph no word has. Accents alone make no misreading.
* Reflow strips headers and page numbers, joins broken words, puts the supported forms in
  and closes up the lines of a paragraph, by SQL windows over (document, line).

Lines and words are rows; the counts are aggregations over the whole corpus with map-side
combine. All windows are per document and share one exchange of the lines. Only forms that
are wrong or contested are joined back to the words, broadcast where their size allows. No
vocabulary goes to the driver.

Defined results: null, empty and blank texts and page text (see ``textkind``) give no rows
and come out of the repair as they are; lines count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from acequia.session import broadcast_if_small, settle

RATIO = 8
DOC = ["table_name", "ingest_seq"]
HYPHENS = "-‐‑¬­"

# Accents, and glyphs brought to strokes so that confusable strings meet.
ACCENTED, PLAIN = "áéíóúàèìòùâêîôûäëïöüãõñçå", "aeiouaeiouaeiouaeiouaonca"
#: Accents that stand apart from their letter (they go).
MARKS = "".join(map(chr, range(0x300, 0x370)))
STROKES = [("\\/", "v"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("m", "rrl"), ("n", "rl"), ("u", "ll"), ("h", "ll"), ("d", "cl"), ("w", "vv")]
LIKE, LEVEL = "ij1|!e0@†5$89q6€¢", "lllllcoatssbggbcc"
#: Glyphs no word of these texts has between its letters.
ODD_GLYPH = r"\p{L}(?:[@†|$¢€0158]|\\/|[ﬁﬂ])|(?:[@†|$¢€0158]|\\/)\p{L}|[ﬁﬂ]"

#: Marks no word of these languages carries.
ODD_MARK = "[ëåäïöèìòùûîÿ]"
#: Shapes of a heading that stands on one page only (a two-page text may show it once):
#: parts set apart, capitals throughout, or a word that opens headings (fixed values).
HEADING_PARTS = r"\S\s+[·/—–|]\s+\S"
HEADING_CAPITALS = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
HEADING_WORDS = ["informe", "memoria anual", "perfil institucional", "company profile", "annual report", "report", "confidencial", "relatorio"]

PAGE_NUMBER = (
    r"^\W*(?:(?i:p[áa]g(?:ina)?|page|p|folio|hoja)\.?\s*)?(?:\d{1,4}|(?i:[ivxl]{1,6}))(?:\s*(?i:de|of|/|-)\s*\d{1,4})?\W*$"
)
#: A bare number that ends a sentence isn't a page number.
SENTENCE_END_NUMBER = r"^\d+[.,;]$"
PAGE_PART = r"(?i)(?:[-–·|/\s\[(]*(?:\b(?:p[áa]g(?:ina)?|page|p)\b\.?\s*)?\b\d{1,4}(?:\s*(?:de|of|/)\s*\d{1,4})?\W*$)|(?:^\W*(?:(?:p[áa]g(?:ina)?|page|p)\b\.?\s*)?\d{1,4}(?:\s*(?:de|of|/)\s*\d{1,4})?[-–·|/\s\])]+)"
#: As textkind.is_scanned: a line ends open and the next goes on in lower case.
SCANNED = "[^.!?:…\"'»)\\]\\s][\"'»)\\]]*[^\\S\\n]*\\n\\s*[a-zà-öø-ÿ]"
OPEN_END = "[^.!?:…\"'»)\\]\\s][\"'»)\\]]*\\s*$"


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED + MARKS, PLAIN)


def skeleton(c: Column) -> Column:
    """The strokes of a word: equal for words that differ by confusable glyphs only."""
    s = folded(F.replace(F.lower(c), F.lit("ñ"), F.lit("fi")))
    for glyph, strokes in STROKES:
        s = F.replace(s, F.lit(glyph), F.lit(strokes))
    return F.translate(s, LIKE, LEVEL)


def _letters(c: Column) -> Column:
    return F.regexp_replace(skeleton(c), r"[^a-z]+", " ")


def _plain_skeleton(text: str) -> str:
    """``skeleton`` of a word in plain letters, for the words that open headings."""
    for glyph, strokes in STROKES:
        text = text.replace(glyph, strokes)
    return text.translate(str.maketrans(LIKE, LEVEL))


def scanned_lines(rows: DataFrame) -> DataFrame:
    """(table_name, ingest_seq, line_no, t, role, cuts, continues, next_first, next_line).

    role is body, blank, header or page. The others are of body lines: whether a word breaks
    off at the end, whether the line begins with the rest of one, and the body line after it.
    """
    scanned = rows.select(*DOC, "text").where(F.col("text").rlike(SCANNED))
    lines = scanned.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select(*DOC, "line_no", F.trim(F.regexp_replace("line", r"[\s\u00a0]+", " ")).alias("t"))
    number = (F.length("t") < 25) & F.col("t").rlike(PAGE_NUMBER) & ~F.col("t").rlike(SENTENCE_END_NUMBER)
    lines = lines.withColumn("blank", F.col("t") == "").withColumn("page", ~F.col("blank") & number)
    masked = F.when(F.col("t").rlike("[0-9]"), F.regexp_replace("t", PAGE_PART, "")).otherwise(F.col("t"))
    lines = lines.withColumn("hkey", F.when(~F.col("blank") & ~F.col("page"), F.trim(_letters(masked))))
    order = W.Window.partitionBy(*DOC).orderBy("line_no")
    back = W.Window.partitionBy(*DOC).orderBy(F.desc("line_no"))
    said = F.when(F.col("hkey").isNotNull(), F.col("t"))
    seen = W.Window.unboundedPreceding
    marked = lines.withColumn("before", F.last(said, True).over(order.rowsBetween(seen, -1))).withColumn("after", F.last(said, True).over(back.rowsBetween(seen, -1)))
    # a line that itself continues, or whose sentence the next line continues, is text
    runs_on = F.col("t").rlike(r"^[a-zà-öø-ÿ]") | (
        F.coalesce(F.col("after").rlike("^[a-zà-öø-ÿ]"), F.lit(False)) & (F.col("before").isNull() | ~F.col("before").rlike(OPEN_END)) & F.col("t").rlike(OPEN_END)
    )
    marked = marked.withColumn("stands", (~runs_on).cast("int"))
    same = W.Window.partitionBy(*DOC, "hkey")
    marked = marked.withColumn("alike", F.count("*").over(same)).withColumn("standing", F.sum("stands").over(same))
    ends_sentence = F.col("t").rlike(r"\p{Ll}{2,}[.!?]$") & ~F.col("t").rlike(r"(?:Ltda|Inc|Cia|Ltd|Corp)\.$")
    company = F.col("t").rlike(r"(?i)(?:\s\.|ltda\.|inc\.|s\.a\.(?:s\.)?)(?:\s+\d+)?$")
    capitals = F.col("t").rlike(HEADING_CAPITALS) & (F.length(F.regexp_replace("t", r"[^\p{Lu}]", "")) >= 6) & (company | ~F.col("t").rlike(r"[.,;:!?]$"))
    first_letters = F.when(F.col("t").rlike(r"^\p{Lu}"), _letters(F.col("t")))
    opens = first_letters.rlike("^(?:" + "|".join(_plain_skeleton(w) for w in HEADING_WORDS) + ") ")
    short = F.size(F.split("t", " ")) <= 14
    shaped = short & ~ends_sentence & (F.col("t").rlike(HEADING_PARTS) | capitals | opens)
    repeated = (F.col("alike") >= 2) & (F.length("hkey") >= 3) & (F.col("standing") * 2 > F.col("alike")) & ~ends_sentence
    header = (F.col("hkey") != "") & (repeated | F.coalesce(shaped, F.lit(False)))
    role = F.when(F.col("blank"), "blank").when(F.col("page"), "page").when(header, "header").otherwise("body")
    told = marked.select(*DOC, "line_no", "t", role.alias("role")).withColumn("toks", F.split("t", " "))
    among = W.Window.partitionBy(*DOC, "role").orderBy("line_no")
    told = told.withColumn("next_first", F.lead(F.col("toks")[0]).over(among)).withColumn("next_line", F.lead("line_no").over(among))
    breaks = F.element_at("toks", -1).rlike(rf"[\p{{L}}@†01][{HYPHENS}]$") & F.col("next_first").rlike(r"^[\p{Ll}@†01\\]")
    told = told.withColumn("cuts", F.coalesce((F.col("role") == "body") & breaks, F.lit(False)))
    told = told.withColumn("continues", F.coalesce(F.lag("cuts").over(among), F.lit(False))).withColumn("last_tok", F.lag(F.element_at("toks", -1)).over(among))
    return told.drop("toks")


#: A word without the punctuation around it.
CORE = r"[\p{L}\p{N}@†$|\\].*[\p{L}\p{N}@†$|]|[\p{L}\p{N}@†$|]"


def body_words(lines: DataFrame) -> DataFrame:
    """The words of body lines, broken ones joined.

    (table_name, ingest_seq, line_no, idx, tok, word, broken, head, tail, tail_line, left): for
    a word broken at the line end ``word`` is the joined form; ``tok`` holds its punctuation;
    ``left`` is the word before it.
    """
    body = lines.where("role = 'body'").withColumn("toks", F.split("t", " ")).withColumn("n", F.size("toks"))
    words = body.select(*DOC, "line_no", "n", "cuts", "continues", "next_first", "next_line", "last_tok", "toks", F.posexplode("toks").alias("idx", "tok"))
    # a continuation's first word belongs to the line before, unless that one-word line goes on itself
    words = words.where(~(F.col("continues") & (F.col("idx") == 0)))
    broken = F.col("cuts") & (F.col("idx") == F.col("n") - 1)
    head = F.regexp_replace("tok", rf"[{HYPHENS}]$", "")
    core = lambda c: F.regexp_extract(c, CORE, 0)
    before = F.when(F.col("idx") == 0, F.col("last_tok")).otherwise(F.get("toks", F.col("idx") - 1))
    told = words.select(
        *DOC, "line_no", "idx", broken.alias("broken"), before.alias("left"),
        F.when(broken, F.concat(head, F.col("next_first"))).otherwise(F.col("tok")).alias("tok"),
        F.when(broken, core(head)).alias("head"),
        F.when(broken, core(F.col("next_first"))).alias("tail"),
        F.when(broken, F.col("next_line")).alias("tail_line"),
    )
    return told.withColumn("word", core(F.col("tok"))).where("word <> ''")


def supported_forms(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms, broken): what the corpus supports.

    forms: form, best (the supported form), misread. broken: head, tail, split (whether
    the joined form is the word), word (the form that counts).
    """
    lower = F.lower("word")
    counts = settle(words.where("not broken").groupBy(lower.alias("form")).agg(F.count("*").alias("n")), "p6-forms")
    by_skeleton = counts.groupBy(skeleton(F.col("form")).alias("sk")).agg(F.sum("n").alias("n"))
    pairs = words.where("broken").select(F.lower("head").alias("head"), F.lower("tail").alias("tail")).distinct()
    joined, compound = F.concat("head", "tail"), F.concat_ws("-", "head", "tail")
    look = lambda c, name: by_skeleton.select(F.col("sk").alias(f"{name}_sk"), F.col("n").alias(f"{name}_n"))
    pairs = pairs.withColumn("j_sk", skeleton(joined)).withColumn("c_sk", skeleton(compound))
    pairs = pairs.join(look(joined, "j"), "j_sk", "left").join(look(compound, "c"), "c_sk", "left")
    split = F.coalesce("j_n", F.lit(0)) >= F.coalesce("c_n", F.lit(0))
    broken = settle(pairs.select("head", "tail", split.alias("split"), F.when(split, joined).otherwise(compound).alias("form")), "p6-broken")

    every = counts.unionByName(broken.select("form", F.lit(0).cast("bigint").alias("n"))).groupBy("form").agg(F.sum("n").alias("n"))
    every = every.withColumn("sk", skeleton(F.col("form"))).withColumn("plain", folded(F.col("form")))
    # a 6 stands for b or for ó: forms with one are looked up both ways
    six = F.when(F.col("form").rlike(r"\p{L}6|6\p{L}"), F.array("sk", skeleton(F.replace("form", F.lit("6"), F.lit("o"))))).otherwise(F.array("sk"))
    # of the forms of a skeleton the most frequent one, accents aside, is supported
    plain = every.groupBy("sk", "plain").agg(F.sum("n").alias("n"), F.max_by("form", "n").alias("top"))
    best = plain.groupBy("sk").agg(F.max_by(F.struct("plain", "n", "top"), F.struct("n", "plain")).alias("b"))
    owned = every.join(plain.select("sk", "plain", F.col("n").alias("own")), ["sk", "plain"])
    looked = owned.select("form", "plain", "own", "n", F.explode(six).alias("sk")).join(best, "sk")
    judged = looked.groupBy("form", "plain", "own", "n").agg(F.max_by("b", F.struct("b.n", "sk")).alias("b"))
    other = F.col("plain") != F.col("b.plain")
    odd = F.col("form").rlike(ODD_GLYPH) & ~F.col("b.plain").rlike(ODD_GLYPH)
    alone_odd = F.col("form").rlike(r"\p{L}(?:[@†]|\\/)\p{L}|^[@†]\p{L}|\p{L}[@†]$|[ﬁﬂ]")
    marked = ~other & (F.col("form") != F.col("b.top")) & F.col("form").rlike(ODD_MARK) & ~F.col("b.top").rlike(ODD_MARK) & (F.col("b.n") >= RATIO * F.col("n"))
    wordlike = F.col("form").rlike(r"[\p{L}@†]")  # numbers are never misread words
    misread = wordlike & ((other & ((F.col("b.n") >= RATIO * F.col("own")) | (odd & (F.col("b.n") >= F.col("own"))))) | marked | alone_odd)
    # forms neither rare nor odd are left to their context
    contested = other & wordlike & ~misread & (F.col("b.n") >= 2 * F.col("own"))
    forms = judged.select("form", F.col("b.top").alias("best"), misread.alias("misread"), contested.alias("contested"))
    return settle(forms, "p6-judged"), broken


def judged_words(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, wrong): body_words with form and split, and those of them that are misread, with best."""
    words = settle(body_words(lines), "p6-words")
    forms, pairs = supported_forms(words)
    b = pairs.select(F.col("head").alias("bh"), F.col("tail").alias("bt"), "split", F.col("form").alias("joined"))
    joined = words.where("broken").join(b, (F.lower("head") == F.col("bh")) & (F.lower("tail") == F.col("bt"))).withColumnRenamed("joined", "form").drop("bh", "bt")
    w = words.where("not broken").withColumn("split", F.lit(False)).withColumn("form", F.lower("word")).unionByName(joined)
    contested = settle(forms.where("contested").select("form", "best"), "p6-contested")
    both = contested.select("form").unionByName(contested.select(F.col("best").alias("form"))).distinct()
    left = F.lower(F.regexp_extract("left", CORE, 0)).alias("left")
    seen = w.join(broadcast_if_small(both), "form").where("left is not null").select("form", left).groupBy("left", "form").agg(F.count("*").alias("k"))
    seen = settle(seen, "p6-contexts")
    mine = seen.join(contested, "form").select("left", "form", "best", "k")
    theirs = seen.select("left", F.col("form").alias("best"), F.col("k").alias("best_k"))
    out_of_context = mine.join(theirs, ["left", "best"]).where(F.col("best_k") >= RATIO * F.col("k")).select("left", "form", "best")
    misread = forms.where("misread").select("form", "best")
    wrong = w.join(broadcast_if_small(misread), "form")
    contextual = w.withColumn("left", left).join(broadcast_if_small(out_of_context), ["left", "form"])
    return w, wrong.unionByName(contextual.select(wrong.columns))


def find_damage(rows: DataFrame) -> DataFrame:
    """(table_name, ingest_seq, line_no, kind) for rows (table_name, ingest_seq, text)."""
    lines = settle(scanned_lines(rows), "p6-lines")
    marks = lines.where("role in ('header', 'page')").select(
        *DOC, "line_no", F.when(F.col("role") == "header", "running_header").otherwise("page_number").alias("kind")
    )
    w, bad = judged_words(lines)
    splits = w.where("broken and split").select(*DOC, "line_no", F.lit("split_word").alias("kind"))
    # in a broken word the wrong glyphs are in the part the supported form doesn't have
    right = F.col("best")
    head_ok, tail_ok = right.startswith(F.lower("head")), right.endswith(F.lower("tail"))
    at = F.when(~F.col("broken"), F.array("line_no")).when(head_ok & ~tail_ok, F.array("tail_line")).when(tail_ok & ~head_ok, F.array("line_no")).otherwise(F.array("line_no", "tail_line"))
    wrong = bad.select(*DOC, F.explode(at).alias("line_no"), F.lit("misread").alias("kind"))
    every = marks.unionByName(splits).unionByName(wrong).distinct()
    return every.select(*DOC, F.col("line_no").cast("bigint").alias("line_no"), "kind")


def repair(rows: DataFrame) -> DataFrame:
    """(table_name, ingest_seq, text): scanned texts reflowed, all others unchanged."""
    lines = settle(scanned_lines(rows), "p6-lines")
    order = W.Window.partitionBy(*DOC).orderBy("line_no")
    shaped = lines.where("role in ('body', 'blank')").withColumn(
        "prev", F.last(F.when(F.col("role") == "body", F.struct("t", "line_no")), True).over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    ).withColumn("gap", F.lag("role").over(order) == "blank").withColumn("width", F.max(F.length("t")).over(W.Window.partitionBy(*DOC)))
    closed = ~F.col("prev.t").rlike(OPEN_END)
    starts = F.coalesce(closed & (F.col("gap") | (F.length("prev.t") < 0.75 * F.col("width"))), F.lit(True))
    para = shaped.where("role = 'body'").withColumn("para", F.sum(starts.cast("int")).over(order)).select(*DOC, "line_no", "para")
    w, bad = judged_words(lines)
    at = [*DOC, "line_no", "idx"]
    w = w.join(bad.select(*at, "best"), at, "left")
    best = F.when(F.col("word").rlike(r"^\p{Lu}[^\p{Ll}]+$"), F.upper("best")).when(F.col("word").rlike(r"^\p{Lu}"), F.initcap("best")).otherwise(F.col("best"))
    kept = F.when(F.col("broken") & ~F.col("split"), F.concat_ws("-", "head", "tail")).otherwise(F.col("word"))
    word = F.concat(F.expr("left(tok, instr(tok, word) - 1)"), F.coalesce(best, kept), F.expr("substring(tok, instr(tok, word) + length(word))"))
    flow = w.join(para, [*DOC, "line_no"]).groupBy(*DOC, "para").agg(F.array_sort(F.collect_list(F.struct("line_no", "idx", word.alias("word")))).alias("ws"))
    text = flow.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("para", F.array_join("ws.word", " ").alias("p")))).alias("ps"))
    fixed = text.select(*DOC, F.array_join("ps.p", "\n\n").alias("fixed"))
    return rows.select(*DOC, "text").join(fixed, DOC, "left").select(*DOC, F.coalesce("fixed", "text").alias("text"))
