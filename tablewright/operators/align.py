"""Aligning table cells with sentences.

Sentences meet the rows or cells of their page in one join on ``page``, with a
JVM substring test as its condition; all else happens inside the rows of that
join.  So cells and sentences are shuffled by page once, n-grams never, and a
page's pairs are streamed, not held.  A sentence (``page, sent_id``) comes once.

``cells``: ``page, table_id, row_index, column_index, text``; ``sents``:
``page, sent_id, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expand_months, is_content_cell, is_statistic, is_unimportant, tokens, tokens_with_offsets

#: Words that a partial match may not consist of.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "which", "with")


def rule_tags(found: Column) -> Column:
    """Entity tags by rule: numbers, percentages and years; a pluggable
    stand-in for a model's tags."""
    return F.transform(found, lambda t: F.when(t.rlike("^(1[0-9]|20)[0-9]{2}$"), F.lit("DATE")).when(t.rlike("^[0-9]+$"), F.lit("CARDINAL")).otherwise(F.lit("")))


def annotated(cells: DataFrame, tagger=rule_tags) -> DataFrame:
    """Adds ``tokens``, ``ner_tags`` and ``is_stat``; months are spelt out."""
    spelt = cells.withColumn("text", expand_months(F.col("text"))).withColumn("tokens", tokens(F.col("text")))
    tagged = spelt.withColumn("ner_tags", tagger(F.col("tokens")))
    return tagged.withColumn("is_stat", is_statistic(F.col("text"), F.col("header"), F.col("tokens"), F.col("ner_tags")))


def said_sentences(sents: DataFrame, *more: Column) -> DataFrame:
    """Adds ``t``, a sentence's tokens, and ``said``, those between blanks: an
    n-gram occurs in it exactly if it does so between blanks."""
    return sents.select("page", "sent_id", F.col("text").alias("sentence"), tokens(F.col("text")).alias("t"), *more).withColumn("said", between_blanks(F.col("t")))


def between_blanks(t: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))


def starts(t: Column, said: Column, gram: Column, n: Column) -> Column:
    """Where the ``n`` tokens ``gram``, between blanks, start in a sentence
    that has them.  The blanks before the first place number it; only where
    there is a second one are all windows compared."""
    first = F.position(gram, said)
    before = F.substring(said, F.lit(1), first - 1)
    single = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    windows = F.filter(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(t, i + 1, n), " "), F.lit(" ")) == gram)
    return F.when(F.position(gram, said, first + 1) == 0, F.array(single)).otherwise(windows)


def is_clear(tags: Column, start: Column, n: Column, is_stat: Column) -> Column:
    """Whether a match is no statistic that touches a token tagged DATE."""
    return ~(F.coalesce(is_stat, F.lit(False)) & F.array_contains(F.slice(tags, start + 1, n), "DATE"))


def cell_rows(cells: DataFrame, *more: str) -> DataFrame:
    """``page, table_id, row_index, cells``: a table's rows with their cells."""
    return cells.groupBy("page", "table_id", "row_index").agg(F.collect_list(F.struct("column_index", "text", *more)).alias("cells"))


def gated_rows(cells: DataFrame, sents: DataFrame, *more: str) -> DataFrame:
    """``sents`` with each row, ``table_id, row_index, cells``, of their page of
    which some cell's text occurs in ``sentence``.  ``page`` is the only join
    key, so what is partitioned by it stays in its place."""
    return sents.join(cell_rows(cells, *more), "page").filter(F.exists("cells", lambda c: is_content_cell(c["text"]) & F.contains(F.col("sentence"), c["text"])))


def exact_alignments(cells: DataFrame, sents: DataFrame, tagger=None) -> DataFrame:
    """``page, sent_id, table_id, row_index, column_index, text, start, end``:
    every n-gram of a sentence that equals a cell's tokens.  With a tagger,
    statistics (``is_stat`` of ``cells``) match no token that is tagged DATE;
    other cells do."""
    t, n = F.col("t"), F.col("n")
    met = exact_cells(cells, said_sentences(sents, *([] if tagger is None else [tagger(tokens(F.col("text"))).alias("tags")])))
    at = met.select("page", "sent_id", "table_id", "row_index", "column_index", "text", "n", F.explode(starts(t, F.col("said"), F.col("gram"), n)).alias("start"), *([] if tagger is None else ["tags", "is_stat"]))
    clear = at if tagger is None else at.filter(is_clear(F.col("tags"), F.col("start"), n, F.col("is_stat")))
    return clear.select("page", "sent_id", "table_id", "row_index", "column_index", "text", "start", (F.col("start") + n).alias("end"))


def exact_cells(cells: DataFrame, sents: DataFrame) -> DataFrame:
    """Cells with their ``n`` tokens between blanks, ``gram``, and the sentences (``said``)
    that have them."""
    t = tokens(F.col("text"))
    cut = cells.withColumn("n", F.size(t)).filter("n > 0").withColumn("gram", between_blanks(t))
    return cut.join(sents, "page").filter(F.contains("said", F.col("gram")))


def longest(t: Column, c: Column) -> Column:
    """The longest, then leftmost, n-gram ``start, end`` of a sentence that is
    shorter than a cell and inside its text on word borders (``inside``,
    ``solo``: which of its tokens may stand alone), null if there is none."""
    n_cell, known = F.size(c["t"]), lambda i: F.array_contains(t, F.get(c["t"], i))
    # Rare, and cheap to say: a token in common that may stand alone, or two in a row.
    near = (n_cell > 1) & F.exists(F.sequence(F.lit(0), F.greatest(n_cell - 1, F.lit(0))), lambda i: known(i) & (F.get(c["solo"], i) | F.coalesce(known(i + 1), F.lit(False))))

    def found(n: Column) -> Column:
        alone = lambda i: (n > 1) | may_stand_alone(F.get(t, i))
        at = F.filter(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.contains(c["inside"], F.concat(F.lit(" "), F.array_join(F.slice(t, i + 1, n), " "), F.lit(" "))) & alone(i))
        return F.get(F.transform(F.slice(at, 1, 1), lambda i: F.struct(i.alias("start"), (i + n).alias("end"))), F.lit(0))

    sizes = F.sequence(F.least(n_cell - 1, F.size(t)), F.lit(1), F.lit(-1))
    return F.when(near, F.aggregate(sizes, F.lit(None).cast("struct<start:int,end:int>"), lambda best, n: F.coalesce(best, found(n))))


def may_stand_alone(token: Column) -> Column:
    """Neither a stopword nor a single punctuation mark."""
    return ~F.lower(token).isin(*STOPWORDS) & ~token.rlike(r"^[^\p{L}\p{N}]$")


def aligned_rows(cells: DataFrame, sents: DataFrame, tagger=rule_tags) -> DataFrame:
    """``page, sent_id, sentence, table_id, row_index, found``: gated rows with
    the cells found in the sentence, ``column_index, text, is_stat, match_type,
    alignments`` (``start, end``).  A cell matches exactly, else partially: by
    its longest, then leftmost, shorter n-gram, unless it is all digits.  A
    row's lone match of a year or a single digit is dropped.  Where ``cells``
    say ``is_stat``, statistics don't match dates exactly, but may partially."""
    marked = cells if "is_stat" in cells.columns else cells.withColumn("is_stat", F.lit(None).cast("boolean"))
    cut = marked.withColumn("t", tokens(F.col("text"))).withColumns({"n": F.size("t"), "inside": between_blanks(F.col("t")), "solo": F.transform("t", may_stand_alone), "digits": F.col("text").rlike("^[0-9]+$")})
    tags = tagger(tokens(F.col("text"))) if "is_stat" in cells.columns else F.lit(None).cast("array<string>")
    rows = gated_rows(cut, said_sentences(sents, tags.alias("tags")), "is_stat", "t", "n", "inside", "solo", "digits")
    t, said = F.col("t"), F.col("said")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def exact(c: Column) -> Column:
        at = F.filter(starts(t, said, c["inside"], c["n"]), lambda i: is_clear(F.col("tags"), i, c["n"], c["is_stat"]))
        return F.when((c["n"] > 0) & F.contains(said, c["inside"]), F.transform(at, lambda i: F.struct(i.alias("start"), (i + c["n"]).alias("end")))).otherwise(none)

    def either(x: Column) -> Column:
        c, whole = x["c"], F.size(x["exact"]) > 0
        part = F.when(~c["digits"], longest(t, c))
        return F.struct(c["column_index"].alias("column_index"), c["text"].alias("text"), c["is_stat"].alias("is_stat"), F.when(whole, F.lit("EXACT")).otherwise(F.lit("PARTIAL")).alias("match_type"), F.when(whole, x["exact"]).otherwise(F.filter(F.array(part), lambda p: p.isNotNull())).alias("alignments"))

    def kept(found: Column) -> Column:
        lone = (F.size(F.array_distinct(found["column_index"])) == 1) & F.forall(found, lambda x: is_unimportant(x["text"]))
        return (F.size(found) > 0) & ~lone

    # One expression, filtered inside an array: as a filter above it would be evaluated for each mention.
    tried = F.transform("cells", lambda c: F.struct(c.alias("c"), exact(c).alias("exact")))
    found = F.filter(F.transform(tried, either), lambda x: F.size(x["alignments"]) > 0)
    return rows.select("page", "sent_id", "sentence", "table_id", "row_index", F.explode(F.filter(F.array(found), kept)).alias("found"))


def aligned(cells: DataFrame, sents: DataFrame, tagger=rule_tags) -> DataFrame:
    """Exact and partial matches of ``aligned_rows``, one to a row."""
    each = aligned_rows(cells, sents, tagger).select("page", "sent_id", "table_id", "row_index", F.explode("found").alias("f"))
    return each.select("page", "sent_id", "table_id", "row_index", "f.column_index", "f.text", "f.match_type", F.explode("f.alignments").alias("a")).select("page", "sent_id", "table_id", "row_index", "column_index", "text", "a.start", "a.end", "match_type")


def candidate_sentences(matches: DataFrame) -> DataFrame:
    """``page, sent_id``: sentences with a statistic or two different texts
    matched; ``matches`` has ``text`` and ``is_stat``."""
    return matches.groupBy("page", "sent_id").agg(F.bool_or("is_stat").alias("s"), F.countDistinct("text").alias("d")).filter("s OR d >= 2").select("page", "sent_id")


def extracted_pairs(cells: DataFrame, sents: DataFrame, tagger=rule_tags) -> DataFrame:
    """``page, table_id, sent_id, sentence, highlighted``: the candidate
    sentences of each table with the cells found in them, ``row_index,
    column_index, text, is_stat, match_type, alignments``.  ``cells`` have
    ``header`` too.  A record holds one table's cells in one sentence."""
    found = aligned_rows(annotated(cells, tagger), sents, tagger)
    row = F.transform("found", lambda f: F.struct(F.col("row_index"), f["column_index"].alias("column_index"), f["text"].alias("text"), f["is_stat"].alias("is_stat"), f["match_type"].alias("match_type"), f["alignments"].alias("alignments")))
    whole = found.groupBy("page", "table_id", "sent_id").agg(F.first("sentence").alias("sentence"), F.array_sort(F.flatten(F.collect_list(row))).alias("highlighted"))
    candidate = F.exists("highlighted", lambda h: h["is_stat"]) | (F.size(F.array_distinct("highlighted.text")) >= 2)
    return whole.filter(candidate).select("page", "table_id", "sent_id", "sentence", "highlighted")


def unique_alignments(cells: DataFrame, contexts: DataFrame) -> DataFrame:
    """Focus entities: highlighted cells with the character spans of their
    exact mentions.  ``contexts``: ``page, sent_id, text``."""
    met = exact_cells(cells, said_sentences(contexts, tokens_with_offsets(F.col("text")).alias("places")))
    p, n = F.col("places"), F.col("n")
    spans = F.transform(starts(F.col("t"), F.col("said"), F.col("gram"), n), lambda i: F.struct(F.get(p, i)["start"].alias("start"), F.get(p, i + n - 1)["end"].alias("end")))
    return met.select("page", "sent_id", "table_id", "row_index", "column_index", "text", F.array_sort(spans).alias("mentions"))


def focus_spans(matches: DataFrame) -> DataFrame:
    """Distinct cells with an exact match."""
    return matches.filter("match_type = 'EXACT'").select("page", "sent_id", "row_index", "column_index").distinct()


def valid_contexts(focus: DataFrame) -> DataFrame:
    """``page, sent_id`` with a row of three focus columns, or two rows of
    exactly two."""
    rows = focus.groupBy("page", "sent_id", "row_index").agg(F.countDistinct("column_index").alias("c"))
    return rows.groupBy("page", "sent_id").agg(F.max("c").alias("most"), F.count_if(F.col("c") == 2).alias("twos")).filter("most >= 3 OR twos >= 2").select("page", "sent_id")


def focus_groups(focus: DataFrame) -> DataFrame:
    """``page, sent_id, row_index, columns``: focus entities by table row."""
    return focus.groupBy("page", "sent_id", "row_index").agg(F.array_sort(F.collect_set("column_index")).alias("columns"))


def high_quality(pairs: DataFrame) -> DataFrame:
    """Pairs whose table has two rows and whose highlighted cells all became
    focus entities (``n_rows, n_highlighted, n_focus``)."""
    return pairs.filter("n_rows >= 2 AND n_highlighted = n_focus")


def highlighted_cells(pairs: DataFrame, header_row: int = 0) -> DataFrame:
    """Highlighted coordinates (row 0 is the header) as ``row_index,
    column_index, text``; body rows count from 0 and the header is
    ``header_row - 1``."""
    each = pairs.select("example_id", "table_id", "grid", F.explode("highlighted_cells").alias("h"))
    return each.select("example_id", "table_id", (F.col("h")[0] - 1 + F.when(F.col("h")[0] == 0, F.lit(header_row)).otherwise(0)).alias("row_index"), F.col("h")[1].alias("column_index"), F.get(F.get("grid", F.col("h")[0]), F.col("h")[1]).alias("text"))
