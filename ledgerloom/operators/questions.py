"""Which table answers a question: an inverted index of titles, headings and row words of all tables, joined to the questions' words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that tell neither a table nor a row.
IDLE = ("a", "an", "and", "by", "for", "from", "in", "is", "of", "on", "page", "sheet", "table", "the", "to", "total", "totals", "was", "what", "which", "with")
LIMIT = r"(?i)\b(?:over|under|above|below|exceeding|more than|less than|at least|at most)\s+[$€£]?\d[\d,]*(?:\.\d+)?"
BUDGET = r"(?i)\b(?:over|under)\s+budget\b"


def _words(text: Column) -> Column:
    return F.array_except(F.array_distinct(T.tokens(F.coalesce(text, F.lit("")))), F.array(*[F.lit(w) for w in IDLE]))


def asked_words(questions: DataFrame) -> DataFrame:
    """(question, doc, word) for each word of (question, doc, text) that says something."""
    return questions.select("question", "doc", F.explode(_words(F.col("text"))).alias("word"))


def chosen_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(question, doc, table) that a question may be about, of (doc, table, title, hidden).

    Where it names a title word that only some of its document's tables have,
    those; else all that are shown; else, where none is shown, all.
    """
    titles = tables.select("doc", "table", F.explode(_words(F.col("title"))).alias("word"))
    count = tables.groupBy("doc").agg(F.count("*").alias("_tables"), F.count_if(~F.col("hidden")).alias("_shown"))
    telling = titles.groupBy("doc", "word").agg(F.count("*").alias("_n")).join(count, "doc").filter("_n < _tables").select("doc", "word")
    named = words.join(titles.join(telling, ["doc", "word"]), ["doc", "word"]).select("question", "doc", "table").distinct()
    open_questions = words.select("question", "doc").distinct().join(named, ["question", "doc"], "left_anti")
    shown = tables.join(count, "doc").filter(~F.col("hidden") | (F.col("_shown") == 0)).select("doc", "table")
    return named.unionByName(open_questions.join(shown, "doc").select("question", "doc", "table"))


def named_columns(words: DataFrame, headings: DataFrame) -> DataFrame:
    """(question, doc, table, columns): how many headings (doc, table, heading) a question names.

    At least half of a heading's words (figures aside) are asked for. A heading
    goes where another of the table is named by the same words and more.
    """
    own = F.filter(_words(F.col("heading")), lambda w: ~w.rlike(r"^[0-9]+$"))
    heads = headings.select("doc", "table", "heading", F.size(own).alias("_size"), F.explode(own).alias("word"))
    hits = words.join(heads, ["doc", "word"]).groupBy("question", "doc", "table", "heading").agg(F.first("_size").alias("_size"), F.array_sort(F.collect_set("word")).alias("hits"))
    named = hits.filter(2 * F.size("hits") >= F.col("_size")).groupBy("question", "doc", "table").agg(F.collect_list("hits").alias("_h"))
    wider = lambda x: F.exists("_h", lambda y: (F.size(y) > F.size(x)) & (F.size(F.array_except(x, y)) == 0))
    return named.select("question", "doc", "table", F.size(F.filter("_h", lambda x: ~wider(x))).alias("columns"))


def named_rows(words: DataFrame, cells: DataFrame, often: int = 64) -> DataFrame:
    """(question, doc, table, named, score) of (doc, table, row, value, is_total).

    named: words of the question in cells that are no figures. score: of the best
    row, 1 for each word and 2 for a word with a digit, half a point less for a
    total row. Words that all rows of a table have
    count once for the table, so that they don't meet every row.

    Of the other words, one that more than ``often`` questions of a document ask
    for and more than ``often`` rows of a table have is common there. Common words
    meet as sets, each set of a table's rows and each set of a document's questions
    once; a question and a row meet by other words only, which makes at most
    ``often`` pairs for each word of a question or row.
    """
    each = cells.select("doc", "table", "row", "is_total", T.parse_amount(F.col("value")).isNull().alias("_text"), F.explode(_words(F.col("value"))).alias("word"))
    index = each.groupBy("doc", "table", "row", "word").agg(F.bool_or("_text").alias("_text"), F.first("is_total").alias("is_total"))
    rows = cells.groupBy("doc", "table").agg(F.countDistinct("row").alias("_rows"))
    spread = index.groupBy("doc", "table", "word").agg(F.count("*").alias("_n"), F.bool_or("_text").alias("_text"), F.bool_or("is_total").alias("_some"), F.bool_and("is_total").alias("_all")).join(rows, ["doc", "table"])
    worth = lambda word: F.when(word.rlike("[0-9]"), 2.0).otherwise(1.0)
    points = worth(F.col("word"))
    everywhere = (F.col("_n") == F.col("_rows")) & (~F.col("_some") | F.col("_all"))
    of_table = words.join(spread, ["doc", "word"]).groupBy("question", "doc", "table").agg(
        F.count_if("_text").cast("int").alias("named"), F.sum(F.when(everywhere, points).otherwise(0.0)).alias("_base"), F.max(F.when(everywhere & F.col("_all"), 0.5).otherwise(0.0)).alias("_less")
    )
    asked = words.groupBy("doc", "word").agg(F.count("*").alias("_asked"))
    rare = spread.filter(~everywhere).join(asked, ["doc", "word"]).select("doc", "table", "word", (F.least("_n", "_asked") > often).alias("_common"))
    of_row = index.join(rare, ["doc", "table", "word"]).groupBy("doc", "table", "row").agg(
        F.array_sort(F.collect_set(F.when(F.col("_common"), F.col("word")))).alias("_has"), F.collect_set(F.when(~F.col("_common"), F.col("word"))).alias("_own"), F.first("is_total").alias("is_total")
    )
    of_question = words.join(rare.filter("_common").select("doc", "word").distinct(), ["doc", "word"]).groupBy("question", "doc").agg(F.array_sort(F.collect_set("word")).alias("_asks"))
    less = F.when(F.col("is_total"), 0.5).otherwise(0.0)
    sets = of_question.select("doc", "_asks").distinct().withColumn("word", F.explode("_asks"))
    kinds = of_row.filter(F.size("_has") > 0).select("doc", "table", "_has", "is_total").distinct().withColumn("word", F.explode("_has"))
    by_sets = sets.join(kinds, ["doc", "word"]).groupBy("doc", "_asks", "table", "_has", "is_total").agg(F.sum(points).alias("_s")).groupBy("doc", "_asks", "table").agg(F.max(F.col("_s") - less).alias("s"))
    pairs = words.join(of_row.withColumn("word", F.explode("_own")), ["doc", "word"]).groupBy("question", "doc", "table", "row").agg(F.sum(points).alias("_s"), F.first("_has").alias("_has"), F.first("is_total").alias("is_total"))
    common = F.coalesce(F.aggregate(F.array_intersect("_asks", "_has"), F.lit(0.0), lambda s, w: s + worth(w)), F.lit(0.0))
    by_row = pairs.join(of_question, ["question", "doc"], "left").select("question", "doc", "table", (F.col("_s") + common - less).alias("s"))
    met = of_question.join(by_sets, ["doc", "_asks"]).select("question", "doc", "table", "s").unionByName(by_row)
    best = met.groupBy("question", "doc", "table").agg(F.max("s").alias("_b"))
    both = of_table.join(best, ["question", "doc", "table"], "left")
    score = F.col("_base") + F.coalesce("_b", -F.col("_less"))
    return both.select("question", "doc", "table", "named", score.alias("score"))


def best_tables(questions: DataFrame, tables: DataFrame, headings: DataFrame, cells: DataFrame) -> DataFrame:
    """(question, table, named, weight): the table that answers each question (question, doc, text) best; none where no table has a word or column of it.

    The table whose rows the question names by more words wins; then the greater
    weight: 2 for each named column, the best row's score, 1 for each limit, 2
    where over or under budget is asked of a table with both columns; then the
    lesser table.
    """
    words = asked_words(questions)
    asked = questions.select("question", F.size(F.regexp_extract_all("text", F.lit(LIMIT), 0)).alias("limits"), F.col("text").rlike(BUDGET).alias("_budget"))
    pairs = headings.groupBy("doc", "table").agg((F.bool_or(F.lower("heading").contains("budget")) & F.bool_or(F.lower("heading").rlike("actual|forecast|spen[dt]"))).alias("_pair"))
    on = ["question", "doc", "table"]
    met = named_rows(words, cells).join(named_columns(words, headings), on, "full").join(chosen_tables(words, tables), on, "left_semi")
    met = met.join(asked, "question").join(pairs, ["doc", "table"], "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    weight = 2 * some("columns") + F.coalesce("score", F.lit(0.0)) + some("limits") + F.when(F.col("_budget") & F.col("_pair"), 2).otherwise(0)
    top = met.select("question", "table", some("named").alias("named"), weight.alias("weight")).groupBy("question").agg(F.max_by(F.struct("table", "named", "weight"), F.struct("named", "weight", F.struct((-F.col("table")).alias("t")))).alias("x"))
    return top.select("question", "x.*")
