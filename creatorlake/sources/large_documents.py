"""One huge indented export document, read by many tasks.

A JSON text never holds a line end inside a string, so each line tells its own quotes; only how deep it lies has to be
known from the lines before it. That is a running sum: per file split first, a few numbers, then inside each split.
No task holds more of the document than one split, or one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from creatorlake.session import stage

# A line without its escapes, strings and all but brackets.
_BRACKETS = r"""regexp_replace(regexp_replace(regexp_replace(value, r'\\.', ''), '"[^"]*"', ''), r'[^{}\[\]]', '')"""
_TOKENS = r"""regexp_extract_all(value, r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^"{}\[\],:]+', 0)"""
_OPEN, _CLOSE = "__t IN ('{', '[')", "__t IN ('}', ']')"
#: Depth inside the document's object, and inside an array of records.
_TOP, _RECORDS = 1, 2
_PIECE = "struct<kind: string, text: string>"


def _lowest(brackets: str) -> str:
    """How far below its start a line's depth goes, 0 or less."""
    return f"""aggregate(split({brackets}, ''), named_struct('at', 0, 'low', 0), (__a, __t) -> named_struct(
        'at', __a.at + CASE WHEN {_OPEN} THEN 1 WHEN {_CLOSE} THEN -1 ELSE 0 END,
        'low', least(__a.low, __a.at + CASE WHEN {_CLOSE} THEN -1 ELSE 0 END)), __a -> __a.low)"""


def _pieces() -> str:
    """A line that touches the outer levels, as what it says there, in order: ``key`` of the top object, ``open`` of an array,
    ``next`` record, and ``part`` of a record's text."""
    after = f"__a.depth + CASE WHEN {_OPEN} THEN 1 WHEN {_CLOSE} THEN -1 ELSE 0 END"
    kind = f"""CASE WHEN __a.depth = {_TOP} AND startswith(__t, '"') THEN 'key' WHEN __a.depth = {_TOP} AND {_OPEN} THEN 'open'
        WHEN __a.depth = {_RECORDS} AND __t = ',' THEN 'next'
        WHEN __a.depth >= {_RECORDS} AND NOT (__a.depth = {_RECORDS} AND {_CLOSE}) THEN 'part' END"""
    return f"""if(depth > {_RECORDS} AND depth + low > {_RECORDS}, array(named_struct('kind', 'part', 'text', value)),
        filter(aggregate({_TOKENS}, named_struct('depth', depth, 'out', CAST(array() AS ARRAY<{_PIECE}>)), (__a, __t) -> named_struct(
            'depth', {after}, 'out', array_append(__a.out, named_struct('kind', {kind}, 'text', __t))), __a -> __a.out), __p -> __p.kind IS NOT NULL))"""


def _before(df: DataFrame, order: list[str], **values: tuple[str, str]) -> DataFrame:
    """``df`` with running aggregates of everything before each row of its file. ``values`` maps a name to its aggregate
    (sum, max or last) and the expression; a split's own part comes from a window, what stands before from its totals."""
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    splits = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source_file", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def total(name: str, expression: str):
        # The last value of a split is that of its last row.
        return F.max_by(F.expr(expression), F.when(F.expr(expression).isNotNull(), F.struct(*order))) if name == "last" else fold[name](F.expr(expression))

    totals = df.groupBy("source_file", "block").agg(*[total(f, e).alias(n) for n, (f, e) in values.items()])
    starts = totals.select("source_file", "block", *[fold[f](n).over(splits).alias(f"_{n}") for n, (f, _) in values.items()])
    joined = df.join(stage(starts, "splits"), ["source_file", "block"])
    for name, (f, e) in values.items():
        here, start = fold[f](F.expr(e)).over(inside), F.col(f"_{name}")
        both = F.coalesce(start, F.lit(0)) + F.coalesce(here, F.lit(0)) if f == "sum" else F.greatest(start, here) if f == "max" else F.coalesce(here, start)
        joined = joined.withColumn(name, both)
    return joined.drop(*[f"_{n}" for n in values])


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, entity, item_pos, record): the elements of every array of the documents' top objects.

    Documents are JSON objects written with line ends (indented); without any, a document is one line and so one task.
    A byte order mark is passed over. Unbalanced documents raise, as records that do not parse do when read."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = lines.withColumn("brackets", F.expr(_BRACKETS))
    net = "length(regexp_replace(brackets, r'[}\\]]', '')) - length(regexp_replace(brackets, r'[{\\[]', ''))"
    lines = stage(lines.selectExpr("* EXCEPT (brackets)", f"{net} AS net", f"{_lowest('brackets')} AS low"), "lines")
    open_ = lines.groupBy("source_file").agg(F.sum("net").alias("net")).where("net <> 0").limit(1).collect()
    if open_:
        raise ValueError(f"brackets do not match in {open_[0]['source_file']}")
    deep = _before(lines, ["line"], depth=("sum", "net"))
    pieces = deep.selectExpr("source_file", "block", "line", f"posexplode({_pieces()}) AS (piece, p)")
    pieces = stage(pieces.selectExpr("source_file", "block", "line", "piece", "p.kind", "p.text",
                                     "if(p.kind IN ('open', 'next'), 1L, 0L) AS starts"), "pieces")
    numbered = _before(pieces, ["line", "piece"], number=("sum", "starts"), entity=("last", "if(kind = 'key', text, NULL)"))
    # Numbers rise, so the array a part lies in is the one opened last: the greatest number so far of an opening.
    numbered = stage(numbered.withColumn("opened", F.expr("if(kind = 'open', number, NULL)")), "numbered")
    placed = _before(numbered.drop("starts"), ["line", "piece"], array_start=("max", "opened"))
    parts = placed.where("kind = 'part'").groupBy("source_file", "entity", "number", "array_start").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "piece", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    elements = parts.select("source_file", "entity", (F.col("number") - F.col("array_start") - 1).cast("int").alias("item_pos"), text.alias("text"))
    elements = elements.where("trim(translate(text, '\t\n\r', '   ')) <> ''")
    return elements.select("source_file", F.expr("variant_get(parse_json(entity), '$', 'string')").alias("entity"), "item_pos",
                           F.parse_json("text").alias("record"))


def entity_records(elements: DataFrame, entity: str) -> DataFrame:
    """``(record_pos, record)`` of one entity, as ``interchange.entity_records`` gives them."""
    rows = elements.where(F.col("entity") == entity)
    return rows.select(F.struct("source_file", "item_pos").alias("record_pos"), "record")
