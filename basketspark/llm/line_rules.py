"""Quality rules on repetition inside documents and on lines that recur across a host's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable
from .tables import broadcast_if_small

WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20
LINE_DOCS = 20
LINE_SHARE = 0.002
MIN_KEPT = 0.3


def repetition(docs: DataFrame, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of whole texts.

    ``n_repeat_words`` counts the words inside windows of five words found twice or more. Window hashes are tested
    for repetition with a hash set first; only texts that have any sort (hash, place) pairs, so the cost stays near
    linear in the longest text. A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*columns, text.alias("t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    parts = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    hashes = f"if(size(w) < {WINDOW}, array(), transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({parts})))"
    d = d.withColumn("h", F.expr(hashes))
    pairs = "if(size(array_distinct(h)) = size(h), array(), array_sort(transform(h, (x, i) -> struct(x as x, i as i))))"
    d = d.withColumn("s", F.expr(pairs))
    twins = "(k > 0 and s[k - 1].x = p.x) or (k + 1 < size(s) and s[k + 1].x = p.x)"
    d = d.withColumn("q", F.expr(f"array_sort(transform(filter(s, (p, k) -> {twins}), p -> p.i))"))
    covered = f"transform(q, (p, k) -> if(k + 1 < size(q), least({WINDOW}, q[k + 1] - p), {WINDOW}))"
    lines = F.expr("filter(split(t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    d = d.withColumns({"c": F.expr(covered), "l": lines})
    d = d.select(
        *columns,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(c, 0L, (a, n) -> a + n)").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _line_table(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """(host, doc, total, line, words): distinct normalised lines by hash; ``doc`` is the text's hash, ``total`` its words."""
    lines = F.expr(
        "transform(filter(split(t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'),"
        " l -> lower(trim(regexp_replace(l, '[\\\\x20\\\\x09-\\\\x0D]+', ' '))))"
    )
    # single spaces: one more word than spaces
    sized = F.expr("transform(array_distinct(n), l -> struct(xxhash64(l) as line, length(l) - length(replace(l, ' ')) + 1 as words))")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("doc"), text.alias("t"))
    d = d.withColumn("n", lines).select("host", "doc", sized.alias("x"))
    total = F.expr("aggregate(x, 0L, (a, y) -> a + y.words)").alias("total")
    return d.select("host", "doc", total, F.inline("x"))


def depleted_documents(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    min_kept: float = MIN_KEPT,
) -> DataFrame:
    """(host, doc, total, removed) of texts that lose too many words with their host's frequent lines.

    Lines are compared lower-cased and with single spaces, by 64-bit hash. A line is frequent if it stands in more
    than ``line_docs`` distinct documents of the host and in more than ``line_share`` of them; copies of a text are
    one document. A text is depleted if under ``min_kept`` of the words in its distinct lines remain. A null host is
    a host. Counts are made by partial aggregation over all lines; only occurrences of frequent lines go further.
    """
    table = stable(_line_table(docs, host_col, text_col))  # read twice, and far smaller than the texts
    hosts = docs.select(F.col(host_col).alias("host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc"))
    hosts = hosts.groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    lines = table.groupBy("host", "line").agg(F.count_distinct("doc").alias("n")).where(F.col("n") > line_docs)
    same = F.col("l.host").eqNullSafe(F.col("h.host"))
    frequent = lines.alias("l").join(broadcast_if_small(stable(hosts)).alias("h"), same)
    frequent = stable(frequent.where(F.col("n") > F.col("docs") * line_share).select("l.host", "line"))
    hit = table.alias("l").join(
        broadcast_if_small(frequent).alias("h"), same & (F.col("l.line") == F.col("h.line"))
    )
    hit = hit.select("l.host", "doc", "total", "l.line", "words").distinct()
    removed = hit.groupBy("host", "doc", "total").agg(F.sum("words").alias("removed"))
    return removed.where(F.col("total") - F.col("removed") < min_kept * F.col("total"))


def line_quality(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits: float
) -> DataFrame:
    """(doc_id, the columns of :func:`repetition`, kept): false if the base rules fail or the document is depleted.

    ``limits`` go to :func:`depleted_documents`. One row per row of ``docs``, repeated rows included; a null text
    has no words and fails, a null id is carried. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    d = d.withColumn("doc", F.xxhash64(F.coalesce("text", F.lit(""))))
    base = repetition(d, "text", ("doc_id", "host", "doc"))
    gone = stable(depleted_documents(d, "host", "text", **limits).select("host", "doc"))
    same = F.col("b.host").eqNullSafe(F.col("g.host")) & (F.col("b.doc") == F.col("g.doc"))
    out = base.alias("b").join(broadcast_if_small(gone).alias("g"), same, "left")
    kept = ~F.col("base_failed") & F.col("g.doc").isNull()
    return out.select("b.*", kept.alias("kept")).drop("host", "doc")
