"""Chat formatting (operator 1): a round-trip grammar in DataFrame functions only.

A turn is rendered as ``### Label: body</turn>`` and a line feed. The label is the role (user, assistant, system and
tool with a capital; any other as ``=`` and its UTF-8 bytes in hex). The parser is deterministic: it splits the text at
``</turn>`` and a line feed, reads the head of every piece, and refuses a body that holds a control string (``### `` or
``</turn>``). A body is first rendered as it is and parsed again; where that does not give back the turn, it is rendered
once more with escapes (head ``### Label:\\ ``), in which a backslash is doubled and the control strings are broken by a
backslash; these bodies hold no control string, so the second parse gives back the source. Both ways are checked by
parsing, and a whole conversation that does not read back as its source raises an error.

Rows are ordered by turn, then role and text (so ties and repeated rows have one order); a null turn comes first; null
role or text counts as empty; rows with a null conv_id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

END, MARK = "</turn>", "### "
KNOWN = ("user", "assistant", "system", "tool")
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(MARK), F.lit("##\\# "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def label_of(role: Column) -> Column:
    return F.when(role.isin(*KNOWN), F.initcap(role)).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "utf-8"))))


def role_of(label: Column) -> Column:
    own = F.decode(F.unhex(F.substring(label, 2, 1 << 30)), "utf-8")
    return F.when(label.startswith("="), own).otherwise(F.lower(label))


def rendered(role: Column, text: Column, escape: bool) -> Column:
    head = F.concat(F.lit(MARK), label_of(role), F.lit(":\\ " if escape else ": "))
    return F.concat(head, escaped(text) if escape else text, F.lit(END + "\n"))


def parsed(piece: Column) -> Column:
    """struct(role, text) of a piece without its end; null where the grammar refuses it."""
    rest = F.substring(piece, len(MARK) + 1, 1 << 30)
    colon = F.locate(":", rest)
    label, tail = rest.substr(F.lit(1), colon - 1), rest.substr(colon + 1, F.lit(1 << 30))
    escape = tail.startswith("\\ ")
    body = F.when(escape, F.substring(tail, 3, 1 << 30)).otherwise(F.substring(tail, 2, 1 << 30))
    good = piece.startswith(MARK) & (colon > 0) & (escape | tail.startswith(" ")) & ~body.contains(MARK) & ~body.contains(END)
    return F.when(good, F.struct(role_of(label).alias("role"), F.when(escape, unescaped(body)).otherwise(body).alias("text")))


def parsed_all(formatted: Column) -> Column:
    pieces = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parsed)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, turns, source): turns are read back; loss_spans are code point ranges [start, end)."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain = rendered(F.col("role"), F.col("text"), False)
    back = F.transform(F.array(plain), lambda t: parsed_all(t))[0]
    same = (F.size(back) == 1) & back[0].eqNullSafe(F.struct("role", "text"))
    turns = turns.withColumn("escape", ~F.coalesce(same, F.lit(False)))
    turns = turns.withColumn("piece", F.when(F.col("escape"), rendered(F.col("role"), F.col("text"), True)).otherwise(plain))
    turns = turns.withColumn("size", F.char_length("piece").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    turns = turns.withColumn("place", F.row_number().over(order))
    body = F.col("at") + len(MARK) + F.char_length(label_of(F.col("role"))) + F.when(F.col("escape"), 3).otherwise(2)
    span = F.when(F.col("role") == "assistant", F.struct(body.alias("start"), (F.col("at") + F.col("size") - len(END) - 1).alias("end")))
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "role", "text", span.alias("span")))).alias("t"))
    packed = packed.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t.piece), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t.span), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"),
    )
    packed = packed.withColumn("turns", parsed_all(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("a conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    return packed.withColumn("turns", F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(wrong.cast(kind)))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped; the two code points before a span tell whether its body is escaped."""
    part = lambda s: formatted.substr((s.start + 1).cast("int"), (s.end - s.start).cast("int"))
    before = lambda s: formatted.substr((s.start - 1).cast("int"), F.lit(2))
    return F.array_join(F.transform(spans, lambda s: F.when(before(s) == "\\ ", unescaped(part(s))).otherwise(part(s))), "")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    out = format_chats(rows.union(planted))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: formatted_chars depends on the template, so the SQL renders the template's length from the source.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, contains(text, '### ') OR contains(text, '</turn>') AS esc,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS body FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN length(role) ELSE 1 + 2 * octet_length(encode(role)) END + 2 + CASE WHEN esc THEN 1 + length(body) ELSE length(text) END + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
