"""Chat formatting with Spark expressions only.

The template of one conversation::

    <s><|start|>role<|sep|>text<|next|>text<|end|><|start|>role<|sep|>text<|end|></s>

Adjacent turns of one role share a block, with ``<|next|>`` between their texts, so the turns
can be read back. Inside roles and texts every backslash is doubled and each control string is
broken by a backslash after its first character (``</s>`` becomes ``<\\/s>``); dropping the
first of each backslash pair restores the text.

Defined cases: a null role or text is empty; turns sort by number, nulls first, ties by role and
text; repeated rows are turns of their own; a null conversation id is a conversation of its own;
an empty table gives no rows; other columns are not read. A conversation is one row, so one task holds it;
time grows with its turns and characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import common

BEGIN, FINISH = "<s>", "</s>"
START, SEP, NEXT, END = "<|start|>", "<|sep|>", "<|next|>", "<|end|>"
#: Pieces whose places are found at once.
CHUNK = 256
#: Where a control string starts: its first character, before the rest of it.
CONTROL = r"(<(?=/?s>|\|)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points from 0, start and length).

    A loss span covers one escaped text of the role ``learn``.
    """
    turns = (
        rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), common.as_text(role).alias("role"), common.as_text(text).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    opens = lambda t, i: (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
    head = lambda t, i: F.when(opens(t, i), F.concat(F.when(i > 0, END).otherwise(""), F.lit(START), escape(t["role"]), F.lit(SEP))).otherwise(NEXT)
    pieces = F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("loss")))

    def spans(pieces: Column) -> Column:
        place = lambda starts: F.transform(pieces, lambda p, i: F.struct(F.get(starts, 2 * i + 1).alias("start"), F.length(p["body"]).alias("length"), p["loss"].alias("loss")))
        found = let(running(F.flatten(F.transform(pieces, lambda p: F.array(F.length(p["head"]), F.length(p["body"])))), len(BEGIN)), place)
        return F.transform(F.filter(found, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    whole = lambda pieces: F.concat(F.lit(BEGIN), F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END + FINISH))
    made = let(pieces, lambda x: F.struct(whole(x).alias("formatted"), spans(x).alias("loss_spans")))
    return turns.select("conv_id", made.alias("made")).select("conv_id", "made.formatted", "made.loss_spans")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column, first: int) -> Column:
    """Where each of consecutive pieces begins. In chunks, as an array that grows by one is copied each time."""
    nothing, empty = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    inner = lambda at, own: F.aggregate(own, state(at, nothing), lambda a, n: state(a["at"] + n, F.array_append(a["out"], a["at"])))
    step = lambda a, own: let(inner(a["at"], own), lambda x: state(x["at"], F.array_append(a["out"], x["out"])))
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
    return F.aggregate(let(sizes, cut), state(F.lit(first), empty), step, lambda a: F.flatten(a["out"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the learned text of formatted conversations: conv_id, turns, loss_text.

    What is under the mask is cut out span by span, unless the spans are the texts of one role: then these
    texts are joined, in time linear in their number.
    """
    inner = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(FINISH)})")
    quoted = {k: rf"\Q{k}\E" for k in (SEP, NEXT, END)}
    parts = F.transform(F.filter(F.split(inner, quoted[END]), lambda b: b != ""), lambda b: F.split(b, quoted[SEP]))

    def piece(head: Column, text: Column, block: Column, i: Column) -> Column:
        """Characters before the text (an end mark before each block but the first), role and text."""
        opening = F.when(block > 0, len(END)).otherwise(0) + F.length(head) + len(SEP)
        return F.struct(F.when(i > 0, len(NEXT)).otherwise(opening).alias("before"), head.substr(F.lit(len(START) + 1), F.length(head)).alias("role"), text.alias("text"))

    pieces = F.flatten(F.transform(parts, lambda b, k: let(F.get(b, F.lit(0)), lambda head: F.transform(F.split(F.get(b, F.lit(1)), quoted[NEXT]), lambda t, i: piece(head, t, k, i)))))
    sizes = lambda x: F.flatten(F.transform(x, lambda p: F.array(p["before"], F.length(p["text"]))))
    place = lambda x, starts: F.transform(x, lambda p, i: F.struct(p["role"].alias("role"), p["text"].alias("text"), F.struct(F.get(starts, 2 * i + 1).alias("start"), F.length(p["text"]).alias("length")).alias("span")))
    spans = lambda x: F.transform(x, lambda p: p["span"])
    slowly = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")

    def learned(x: Column) -> Column:
        role = F.get(x, (F.array_position(spans(x), F.get("loss_spans", F.lit(0))) - 1).cast("int"))["role"]
        own = let(role, lambda r: F.filter(x, lambda p: p["role"] == r))
        return F.when(F.size("loss_spans") == 0, "").otherwise(let(own, lambda y: F.when(spans(y) == F.col("loss_spans"), F.array_join(F.transform(y, lambda p: unescape(p["text"])), "")).otherwise(slowly)))

    turns = lambda x: F.transform(x, lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text")))
    back = let(let(pieces, lambda x: let(running(sizes(x), len(BEGIN)), lambda starts: place(x, starts))), lambda x: F.struct(turns(x).alias("turns"), learned(x).alias("loss_text")))
    return formatted.withColumn("_back", back).select(*[common.column(c) for c in formatted.columns], "_back.turns", "_back.loss_text")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: both texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.sql(f"select * from values (-1L, 0L, 'user', '{text}'), (-1L, 1L, 'assistant', '{text}') as v(conv_id, turn, role, text)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe(spark))
    back = read_back(format_chat(rows))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, coalesce(lag(role) over w <> role, true) as opens,
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '</?s>|<\||\[/?INST\]')) as n_text,
    length(role) + length(role) - length(replace(role, '\', ''))
      + len(regexp_extract_all(role, '</?s>|<\||\[/?INST\]')) as n_role
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(7 + sum(n_text + case when opens then n_role + 9 + 7 + 7 else 8 end) as bigint) as formatted_chars
from marked group by conv_id
"""
