"""Question-answer generation from sentences and tables, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.answers import has_any
from corpusmill.functions.text import let
from corpusmill.operators.chunking import line_runs, markdown_rows, sentence_spans
from corpusmill.operators.scale import first_k

# Patterns and word lists of the generator.
NUM = r"\(?\$?\d[\d,]*(?:\.\d+)?\)?%?"
MONEY_OR_RATE = r"\$\s*\d[\d,]*(?:\.\d+)?|\d(?:[\d,]*\.?\d+)?%"
FINANCE = [
    "revenue", "income", "operating", "gross", "net", "cash", "assets", "liabilities", "equity", "margin", "earnings", "expense",
    "tax", "diluted", "basic", "segment", "cloud", "commercial", "products", "services",
]
NOISE = [
    "washington", "commission file", "form 10-q", "telephone", "page", "section 13", "rule 12b", "october", "registrant",
]
UNIT_WORDS = ["million", "billion", "thousand", "basis points", "percent"]


def _closed(token: Column) -> Column:
    t = F.btrim(token)
    return F.when(t.startswith("(") & ~t.endswith(")"), F.concat(t, F.lit(")"))).otherwise(t)


def _financial(c: Column) -> Column:
    low = F.lower(c)
    return ~has_any(low, NOISE) & has_any(low, FINANCE)


def _all(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), _closed)


def best_number(sentence: Column) -> Column:
    """Amount or rate a sentence is about: a ``$`` or ``%`` one first, else a number that is no year or count."""
    money = _all(sentence, MONEY_OR_RATE)
    marked = F.filter(money, lambda t: F.contains(t, F.lit("%")) | F.contains(t, F.lit("$")))
    plain = F.filter(
        _all(sentence, NUM),
        lambda t: (F.length(F.btrim(t, F.lit("(),$"))) > 2) & ~F.btrim(t, F.lit("(),$")).isin("2024", "2025", "2026"),
    )
    note = F.contains(F.lower(sentence), F.lit("note ")) & (F.size(money) == 0)
    return F.when(~note, F.coalesce(F.get(marked, F.lit(0)), F.get(money, F.lit(0)), F.get(plain, F.lit(0))))


def qa_sentences(docs: DataFrame, source: str, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Questions about sentences with an amount or rate; the answer carries the unit, the evidence its offsets."""
    rows = sentence_spans(docs, text, key)
    s, low = F.col("sentence"), F.lower("sentence")
    rows = rows.where(
        (F.length(s) >= 35) & s.rlike(NUM) & _financial(s) & (s.rlike(MONEY_OR_RATE) | has_any(low, UNIT_WORDS))
    )
    # The first sentence of equal ones asks the question.
    rows = rows.groupBy(low.alias("_low")).agg(F.min_by(F.struct(key, "sentence", "start"), F.struct(key, "start")).alias("r")).select("r.*")
    rows = rows.withColumn("token", best_number(s)).where(F.col("token").isNotNull())
    bare = F.btrim("token", F.lit("(),$"))
    rows = rows.where(~(bare.rlike(r"^\d+$") & (F.length(bare) <= 2)))
    unit = F.lower(F.expr(r"regexp_extract(sentence, concat('(?i)\\Q', token, '\\E\\s*(million|billion|thousand|trillion)\\b'), 1)"))
    dollar = F.col("token").startswith("$")
    answer = (
        F.when(F.contains("token", F.lit("%")), F.col("token"))
        .when(unit != "", F.concat("token", F.lit(" "), unit, F.when(dollar, " USD").otherwise("")))
        .otherwise(F.concat("token", F.when(dollar, " USD").otherwise("")))
    )
    rows = rows.withColumn("answer", answer).where(
        F.contains(s, "token") & (F.col("token").rlike(MONEY_OR_RATE) | has_any(low, UNIT_WORDS))
    )
    at = F.position("token", "sentence") - 1
    question = F.concat(F.lit(f'According to {source}, what is the reported amount or rate in this sentence: "'), s, F.lit('"?'))
    return rows.select(
        key, "start", question.alias("question"), "answer", F.col("sentence").alias("evidence"), at.alias("answer_start"),
        (at + F.length("token")).alias("answer_stop"),
    )


def table_facts(docs: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Number rows of each table of each document: table, header, cells, label, unit; all found inside the document's row.

    A table is a run of table lines, with its own header and unit; ``row`` counts on over the tables of a document.
    """
    joined = lambda rows: F.array_join(F.flatten(rows), " ")

    def scale_of(c: Column) -> Column:
        low = F.lower(c)
        pick = F.when(F.contains(low, F.lit("in millions")), "million").when(F.contains(low, F.lit("in billions")), "billion")
        return pick.when(F.contains(low, F.lit("in thousands")), "thousand").otherwise("")

    def unit(has_dollar: Column, scale: Column) -> Column:
        return F.btrim(F.concat(F.when(has_dollar, "USD ").otherwise(""), scale))

    tables = F.transform(F.filter("runs", lambda r: r["is_table"]), lambda r: markdown_rows(F.array_join(r["lines"], "\n")))
    rows = line_runs(docs, text).select(key, tables.alias("tables"))
    rows = rows.select(key, "tables", F.posexplode("tables").alias("table", "rows")).where(F.size("rows") > 0)
    before = F.aggregate(F.slice("tables", F.lit(1), F.col("table")), F.lit(0), lambda n, t: n + F.size(t))
    rows = rows.select(key, "table", before.alias("before"), "rows")
    full = F.transform(F.slice("rows", 1, 6), lambda r: F.size(F.filter(r, lambda c: c != "")) >= 2)
    rows = rows.withColumn("head", F.array_position(full, F.lit(True)).cast("int")).where("head > 0")
    rows = rows.select(
        key, "table", "before", "head", F.element_at("rows", F.col("head")).alias("header"),
        unit(F.contains(joined(F.col("rows")), F.lit("$")), scale_of(joined(F.slice("rows", 1, 8)))).alias("table_unit"),
        F.posexplode("rows").alias("row", "cells"),
    ).where(F.col("row") >= F.col("head"))
    n = F.size(F.filter("cells", lambda c: c.rlike(NUM)))
    label = F.get("cells", F.lit(0))
    rows = rows.withColumn("label", label).where((label != "") & (n >= 1) & (_financial(label) | (n >= 2)))
    head_text, row_text = F.lower(F.array_join("header", " ")), F.array_join("cells", " ")
    own = (
        F.when(F.contains(F.lower(row_text), F.lit("shares")) | F.contains(head_text, F.lit("outstanding")), "shares")
        .when(F.contains(head_text, F.lit("except per share")) & F.lower("label").isin("basic", "diluted"), "USD/share")
        .otherwise(unit(F.contains(F.concat(row_text, head_text), F.lit("$")), scale_of(head_text)))
    )
    return rows.select(
        key, "table", (F.col("before") + F.col("row")).cast("bigint").alias("row"), "header", "cells", "label",
        F.coalesce(F.nullif(own, F.lit("")), "table_unit").alias("unit"), F.array_join("cells", " | ").alias("row_text"),
    )


def _with_unit(token: Column, unit: Column) -> Column:
    bare = (unit == "") | F.contains(token, F.lit("%")) | token.rlike(r"\p{L}")
    return F.when(bare, token).otherwise(F.concat(token, F.lit(" "), unit))


def _number_cells(facts: DataFrame, key: str) -> DataFrame:
    """One row per number cell right of the label: col, token, column name."""
    width = F.least(F.size("cells"), F.size("header"))
    pairs = F.transform(
        F.slice("cells", F.lit(2), F.greatest(width - 1, F.lit(0))),
        lambda c, i: F.struct((i + 1).alias("col"), _closed(c).alias("token"),
                              F.coalesce(F.nullif(F.get("header", i + 1), F.lit("")), F.concat(F.lit("column "), (i + 2).cast("string"))).alias("name")),
    )
    return facts.withColumn("nums", F.filter(pairs, lambda p: p["token"].rlike(NUM)))


def qa_cells(docs: DataFrame, source: str, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Questions for the value of a row under a column."""
    rows = _number_cells(table_facts(docs, text, key), key).select(key, "row", "label", "unit", "row_text", F.explode("nums").alias("c"))
    question = F.concat(F.lit(f"According to {source}, what is the reported value for '"), "label", F.lit("' under '"), F.col("c.name"), F.lit("'?"))
    at = F.position(F.col("c.token"), F.col("row_text")) - 1
    return rows.where(at >= 0).select(
        key, "row", F.col("c.col").cast("bigint").alias("col"), question.alias("question"),
        _with_unit(F.col("c.token"), F.col("unit")).alias("answer"), F.col("row_text").alias("evidence"), at.alias("answer_start"),
    )


def _rounded(value: Column, places: int) -> Column:
    """A double with so many places. Its exact binary value is rounded, not its shortest decimal form as in format_string."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def qa_arithmetic(docs: DataFrame, source: str, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Difference and percent change of a row's first two numbers, and the ratio to the next row's number."""
    said = f"According to {source}, what is the "
    facts = _number_cells(table_facts(docs, text, key), key)
    values = F.filter(
        F.transform("nums", lambda p: F.struct(p["col"].alias("col"), p["name"].alias("name"), T.parse_number(p["token"]).alias("v"))),
        lambda p: p["v"].isNotNull(),
    )
    facts = facts.withColumn("vals", values)
    two = facts.where(F.size("vals") >= 2).select(
        key, "row", "label", "unit", F.col("vals")[0]["v"].alias("v1"), F.col("vals")[1]["v"].alias("v2"),
        F.col("vals")[0]["name"].alias("c1"), F.col("vals")[1]["name"].alias("c2"),
    )
    diff = F.col("v1") - F.col("v2")
    change = F.when(F.col("v2") == 0, "n/a").otherwise(F.concat(_rounded(diff / F.nullif(F.abs("v2"), F.lit(0.0)) * 100, 2), F.lit("%")))
    difference = two.select(
        key, "row", F.lit("difference").alias("kind"),
        F.concat(F.lit(said + "absolute difference for '"), "label", F.lit("' between '"), "c1", F.lit("' and '"), "c2", F.lit("'?")).alias("question"),
        _with_unit(F.format_number(diff, 2), F.col("unit")).alias("answer"),
    )
    percent = two.select(
        key, "row", F.lit("percent_change").alias("kind"),
        F.concat(F.lit(said + "percent change for '"), "label", F.lit("' from '"), "c2", F.lit("' to '"), "c1", F.lit("'?")).alias("question"),
        change.alias("answer"),
    )
    # Neighbouring number rows of one table: they come from one text, so they are few.
    packed = facts.groupBy(key, "table").agg(F.array_sort(F.collect_list(F.struct("row", "label", "vals"))).alias("rs"))
    ratios = let(F.col("rs"), lambda rs: F.zip_with(
        F.slice(rs, F.lit(1), F.greatest(F.size(rs) - 1, F.lit(0))), F.slice(rs, F.lit(2), F.greatest(F.size(rs) - 1, F.lit(0))),
        lambda a, b: F.struct(
            a["row"].alias("row"), a["label"].alias("l1"), b["label"].alias("l2"),
            F.get(F.filter(F.transform(a["vals"], lambda x: F.struct(
                x["name"].alias("name"),
                (x["v"] / F.nullif(F.get(F.filter(b["vals"], lambda y: y["col"] == x["col"]), F.lit(0))["v"], F.lit(0.0))).alias("r"),
            )), lambda x: x["r"].isNotNull()), F.lit(0)).alias("x"),
        ),
    ))
    ratio = packed.select(key, F.explode(ratios).alias("z")).where("z.x IS NOT NULL").select(
        key, "z.row", F.lit("ratio").alias("kind"),
        F.concat(F.lit(said + "ratio of '"), F.col("z.l1"), F.lit("' to '"), F.col("z.l2"), F.lit("' for '"), F.col("z.x.name"), F.lit("'?")).alias("question"),
        F.concat(_rounded(F.col("z.x.r"), 4), F.lit("x")).alias("answer"),
    )
    return difference.unionByName(percent).unionByName(ratio)


def qa_select(qas: DataFrame, caps: dict[str, int], order: list[str]) -> DataFrame:
    """One of each (question, answer), a capped number per group, numbered ``G1-001`` on.

    ``qas``: grp (``Group1`` and so on), question, answer and the order columns.
    """
    rows = first_k(qas.withColumn("_q", F.lower("question")), ["grp", "_q", "answer"], [F.col(c) for c in order], 1).drop("_q")
    most = max(caps.values())
    rows = first_k(rows, ["grp"], [F.col(c) for c in order], most, rank="number")
    cap = T.lookup(F.col("grp"), caps, F.lit(0))
    name = F.format_string("%s-%03d", F.replace("grp", F.lit("Group"), F.lit("G")), F.col("number"))
    return rows.where(F.col("number") <= cap).withColumn("qa_id", name)


def qa_lint(qas: DataFrame) -> DataFrame:
    """Counts of date-like, single-digit and unclosed answers."""
    g1, g2, a = F.col("grp") == "Group1", F.col("grp") == "Group2", F.col("answer")
    return qas.agg(
        F.count("*").alias("total"),
        F.count_if(g1 & a.rlike(r"^\d{1,2},?$")).alias("date_like"),
        F.count_if(g1 & a.rlike("^[1-9]$")).alias("single_digit"),
        F.count_if(g2 & a.startswith("(") & ~a.endswith(")")).alias("unclosed"),
    )
