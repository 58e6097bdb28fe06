"""Text, table, chart and graph operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import kept

#: Fixed value: consonant runs that mark garbled words.
CONSONANTS = r"[^aeiouAEIOU\s\d]{4,}"


def text_lines(docs: DataFrame) -> DataFrame:
    """Trimmed lines that are not blank, with their place."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", "p", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("p")
    return lines.select("doc_id", F.row_number().over(w).alias("line_no"), "line")


def garbled(column: Column, limit: float = 0.45) -> Column:
    """Short texts, and texts whose letters lie mostly in long consonant runs."""
    letters = F.length(F.regexp_replace(column, "[^A-Za-z]", ""))
    runs = F.aggregate(F.regexp_extract_all(column, F.lit(CONSONANTS), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.length(column) < 3, True).when(letters == 0, False).otherwise(runs / letters > limit)


def keywords(docs: DataFrame, k: int = 12) -> DataFrame:
    """The first k distinct lower-cased words of three characters or more."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), F.lower)
    return docs.select("doc_id", F.array_join(F.slice(F.array_distinct(words), 1, k), ",").alias("keywords"))


def similarity(a: Column, b: Column) -> Column:
    """Common distinct words over the larger number of distinct words; 1 where both have none."""
    return shared_words(distinct_words(a), distinct_words(b))


def distinct_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)))


#: Items that a document is compared with at once, and the bytes of items, about, that go to all tasks at once.
ITEM_BLOCK, ITEM_BYTES = 512, 64 << 20


def best_items(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity): every document with the item that is most like it, of equals the smallest id.

    The items are a stated set of queries: they go in blocks, as sets of words, to the documents, and no pair is ever a row.  More items than fit in
    ``item_bytes`` go in pages, one pass over the documents each, of which only the best item so far is kept."""
    x = docs.select("doc_id", distinct_words(F.coalesce("text", F.lit(""))).alias("x"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    pages = size["b"] // item_bytes + 1
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "item_id"), F.lit(n))
    word = items.select(spread(1, pages).alias("page"), spread(2, size["n"] // (ITEM_BLOCK * pages) + 1).alias("block"), F.struct("item_id", distinct_words(F.coalesce("text", F.lit(""))).alias("y")).alias("i"))
    best = F.array_max(F.transform("items", lambda i: F.struct(F.bround(shared_words(F.col("x"), i["y"]), 6).alias("s"), (-i["item_id"]).alias("i"))))

    def page(k: int) -> DataFrame:
        blocks = word.where(F.col("page") == k).groupBy("block").agg(F.collect_list("i").alias("items"), F.lit(1).alias("one"))
        return x.withColumn("one", F.lit(1)).join(F.broadcast(blocks), "one").select("doc_id", best.alias("b"))

    met = page(0) if pages == 1 else reduce(DataFrame.union, (kept(page(k).groupBy("doc_id").agg(F.max("b").alias("b")), "best") for k in range(pages)))
    return met.groupBy("doc_id").agg(F.max("b").alias("b")).select("doc_id", (-F.col("b.i")).alias("item_id"), F.col("b.s").alias("similarity"))


def shared_words(x: Column, y: Column) -> Column:
    """``similarity`` of arrays of distinct words."""
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The first 16 hex digits of the text's SHA-256, and word and line estimates."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)))
    return docs.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"), words.alias("words"), F.greatest(F.lit(1), F.floor(words / 12).cast("int")).alias("lines"))


def sections(turns: DataFrame) -> DataFrame:
    """Runs of consecutive turns of one role: first and last turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    start = F.coalesce((F.lag("role").over(w) != F.col("role")).cast("long"), F.lit(1))
    run = turns.withColumn("s", start).withColumn("section", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("conv_id", "section", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


def last_user_turn(turns: DataFrame) -> DataFrame:
    """Each other turn under the last user turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("parent_turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)).where("role <> 'user'").select("conv_id", "turn", "parent_turn")


def chart_profile(points: DataFrame) -> DataFrame:
    """By series (series, idx, category, value): trend, mean, deviation, peak, low, and how many points lie beyond two
    deviations."""
    w = Window.partitionBy("series")
    p = points.withColumns({"mu": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w), "n": F.count("*").over(w)})
    a = p.groupBy("series").agg(
        F.expr("min_by(value, idx)").alias("first"), F.expr("max_by(value, idx)").alias("last"), F.bround(F.first("mu"), 2).alias("mean"), F.bround(F.first("sd"), 2).alias("deviation"),
        F.expr("max_by(category, struct(value, -idx))").alias("peak"), F.expr("min_by(category, struct(value, idx))").alias("low"),
        F.count_if(F.expr("n >= 3 and abs(value - mu) > 2 * sd")).alias("anomalies"),
    )
    trend = F.when(F.col("last") > F.col("first") * 1.05, "increasing").when(F.col("last") < F.col("first") * 0.95, "decreasing").otherwise("stable")
    return a.withColumn("trend", trend).drop("first", "last")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree of every node (page, node), and whether it starts or ends a flow."""
    keys = ["document_id", "slide_number"]
    out = edges.groupBy(*keys, F.col("source_element_id").alias("element_id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(*keys, F.col("target_element_id").alias("element_id")).agg(F.count("*").alias("in_degree"))
    both = nodes.select(*keys, "element_id").join(out, [*keys, "element_id"], "left").join(into, [*keys, "element_id"], "left").na.fill(0, ["out_degree", "in_degree"])
    return both.withColumns({"is_start": F.expr("in_degree = 0 and out_degree > 0"), "is_end": F.expr("out_degree = 0 and in_degree > 0")})


def flow_type(edges: DataFrame) -> DataFrame:
    """Per page: branching where a node has two ways out, cyclic where edges are as many as nodes, else linear."""
    keys = ["document_id", "slide_number"]
    out = edges.groupBy(*keys, "source_element_id").agg(F.count("*").alias("o")).groupBy(*keys).agg(F.max("o").alias("most"), F.sum("o").alias("edges"))
    ends = edges.select(*keys, F.explode(F.array("source_element_id", "target_element_id")).alias("n")).distinct().groupBy(*keys).agg(F.count("*").alias("nodes"))
    return out.join(ends, keys).select(*keys, "edges", "nodes", F.expr("case when most > 1 then 'branching' when edges >= nodes then 'cyclic' else 'linear' end").alias("flow_type"))


def luminance(hex_: Column) -> Column:
    """.299 R + .587 G + .114 B of ``#rrggbb``."""
    part = lambda i: F.conv(F.substring(hex_, i, 2), 16, 10).cast("double")
    return 0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6)


def palette(colors: DataFrame) -> DataFrame:
    """Per page (document_id, slide_number, color): sorted distinct colours, theme, contrast text of the first."""
    keys = ["document_id", "slide_number"]
    a = colors.withColumn("dark", luminance(F.col("color")) < 127.5).groupBy(*keys).agg(F.sort_array(F.collect_set("color")).alias("c"), F.count_if("dark").alias("d"), F.count("*").alias("n"))
    return a.select(*keys, F.array_join("c", ",").alias("colors"), F.expr("if(d > n / 2, 'dark', 'light')").alias("theme"), F.when(luminance(F.element_at("c", 1)) < 130, "#ffffff").otherwise("#000000").alias("contrast"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """Slots of a grid (table_id, row, col, row_span, col_span) that no other cell's span covers."""
    wide = cells.where("row_span > 1 or col_span > 1")
    cover = wide.select("table_id", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(F.expr("sequence(row, row + row_span - 1)")).alias("row"), "col", "col_span")
    cover = cover.select("table_id", "r0", "c0", "row", F.explode(F.expr("sequence(col, col + col_span - 1)")).alias("col")).where("row <> r0 or col <> c0")
    return cells.join(cover.select("table_id", "row", "col").distinct(), ["table_id", "row", "col"], "left_anti").select("table_id", "row", "col", "row_span", "col_span")


def multipage_tables(tables: DataFrame, share: float = 0.8) -> DataFrame:
    """Tables (doc, page, ord, columns, headers) that the next page's next table continues: the same number of columns and
    more than ``share`` of its headers, trimmed and in lower case."""
    w = Window.partitionBy("doc").orderBy("page", "ord")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("page", "columns", "headers")}
    same = F.expr("size(filter(next_headers, h -> array_contains(headers, h))) / size(next_headers)")
    tables = tables.withColumn("headers", F.transform("headers", lambda h: F.lower(F.trim(F.coalesce(h.cast("string"), F.lit(""))))))
    t = tables.withColumns(nxt).where("next_page = page + 1 and columns = next_columns and columns > 0")
    return t.where(same > share).select("doc", "page", "next_page")
