"""Chat formatting in budgeted windows (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Tokens of a window, and of the earlier turns that it repeats.
BUDGET, HISTORY = 1024, 256
#: Tokens of a conversation that are cut into windows together; of a longer one, several tasks do a chapter each.
CHAPTER_TOKENS = 64 * 1024
#: Characters of role and text that order turns of one number before a hash does.
TIE_CHARS = 64

# The template: [INST] user [/INST], <s>assistant</s>, [SYS] system [/SYS], and [ROLE] name, line feed, text [/ROLE]
# for any other role. Inside texts a backslash is doubled, and one is put behind the first character of a control string.
CONTROL = re.compile(r"(<|\[)(?=/?(?:s>|INST\]|SYS\]|ROLE\]))")
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[SYS\] (.*?) \[/SYS\]|\[ROLE\] (.*?)\n(.*?) \[/ROLE\]", re.S)
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked-up turn, and where its text begins and stops in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        name = role.replace("%", "%25").replace("\n", "%0A")
        before, after = f"[ROLE] {escape(name)}\n", " [/ROLE]"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for m in TURN.finditer(formatted):
        user, assistant, system, name, other = m.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif assistant is not None:
            out.append(("assistant", unescape(assistant)))
        elif system is not None:
            out.append(("system", unescape(system)))
        else:
            out.append((unescape(name).replace("%0A", "\n").replace("%25", "%"), unescape(other)))
    return out


def windows(
    turns: list[tuple[str, int, int, int, bool]], earlier: int, system: tuple[str, int] | None, budget: int, history: int, opens: bool = True
) -> Iterator[tuple[str, int, list[tuple[int, int]], int]]:
    """(text, where the new turns begin, loss spans, tokens) of each window.

    turns: (formatted, begin, stop, tokens, is assistant); the first `earlier` only serve as history.
    system: the formatted system turn, which every window retains, and its tokens; if `opens`, it is turns[0] too.
    Prefix sums of the tokens give by binary search the last turn that fits. Where no new turn
    fits beside the history there is none; a turn that doesn't fit alone has a window to itself,
    and so has each turn under a system turn that leaves no room: such windows exceed the budget.
    """
    total = np.cumsum([0, *(t[3] for t in turns)])
    opens = opens and system is not None
    i, n = earlier, len(turns)
    while i < n:
        kept = None if system is None or (opens and i == 0) else system
        room = max(0, budget - (kept[1] if kept else 0))
        back = int(np.searchsorted(total, total[i] - min(history, room // 2)))
        back = min(i, max(back, int(opens)))  # the system turn isn't repeated twice
        j = int(np.searchsorted(total, total[back] + room, "right")) - 1
        if j <= i:
            back, j = i, max(i + 1, int(np.searchsorted(total, total[i] + room, "right")) - 1)
        head = (kept[0] if kept else "") + "".join(t[0] for t in turns[back:i])
        spans, parts, at = [], [head], len(head)
        for text, begin, stop, _, target in turns[i:j]:
            if target:
                spans.append((at + begin, at + stop))
            parts.append(text)
            at += len(text)
        yield "".join(parts), len(head), spans, int(total[j] - total[back]) + (kept[1] if kept else 0)
        i = j


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows in order, by runs of equal keys."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _mark(tokenizer: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each turn's marked-up form, where its text stands in it, its tokens, the partition's number, and the turns and
    tokens of the conversation before it in the partition."""
    from .token_files import _encoder

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, last, turns, total = _encoder(tokenizer), TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            roles = batch.column("role").to_pylist()
            forms = [format_turn(r, t) for r, t in zip(roles, batch.column("text").to_pylist())]
            tokens = [len(x) // 4 for x in encoder.encode([f for f, _, _ in forms])]
            place, before = [], []
            for key, n in zip(zip(batch.column("orphan").to_pylist(), batch.column("conv_id").to_pylist()), tokens):
                if key != last:
                    last, turns, total = key, 0, 0
                place.append(turns)
                before.append(total)
                turns, total = turns + 1, total + n
            columns = [
                batch.column("orphan"), batch.column("conv_id"), pa.array([f[0] for f in forms], pa.string()), pa.array([f[1] for f in forms], pa.int32()),
                pa.array([f[2] for f in forms], pa.int32()), pa.array(tokens, pa.int64()), pa.array([r == "assistant" for r in roles]), pa.array([r == "system" for r in roles]),
                pa.array(np.full(len(roles), part, np.int32)), pa.array(place, pa.int64()), pa.array(before, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MARKED.split(", ")])

    return run


MARKED = "orphan boolean, conv_id long, form string, begin int, stop int, tokens long, target boolean, system boolean, part int, place long, before long"


def placed(turns: DataFrame, tokenizer: str) -> DataFrame:
    """MARKED columns but part: each turn's place in its conversation and the tokens before it are those of the whole conversation.

    Turns are sorted by ranges of (conversation, turn), so a long conversation
    covers several partitions. Each counts from its own start; only a partition's
    first conversation can have begun earlier, and what lies before it is one
    row a partition, small enough to broadcast.
    """
    rows = turns.select(
        F.col("conv_id").isNull().alias("orphan"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = ["orphan", "conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, TIE_CHARS), F.substring("text", 1, TIE_CHARS), F.xxhash64("role", "text"), "row"]
    ordered = rows.repartitionByRange(common.partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys).drop("row", "turn")
    stored = common.stored(ordered.mapInArrow(_mark(tokenizer), MARKED), "turns")
    totals = stored.groupBy("orphan", "conv_id", "part").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("orphan", "conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = totals.withColumns({"turns_before": F.sum("turns").over(earlier), "tokens_before": F.sum("tokens").over(earlier)}).filter("turns_before > 0")
    base = base.select("orphan", "conv_id", "part", "turns_before", "tokens_before")
    joined = stored.join(F.broadcast(base), ["orphan", "conv_id", "part"], "left")
    return joined.withColumns({"place": F.col("place") + F.coalesce("turns_before", F.lit(0)), "before": F.col("before") + F.coalesce("tokens_before", F.lit(0))}).drop(
        "part", "turns_before", "tokens_before"
    )


def _format(budget: int, history: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["conv_id", "chapter", "window", "text", "new_at", "spans", "n_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (orphan, conv, chapter), rows in _grouped(batches, ["orphan", "conv_id", "chapter"]):
            system = (rows[0]["form"], rows[0]["tokens"]) if rows[0]["part"] == SYSTEM else None
            rows = rows[system is not None :]
            turns = [(r["form"], r["begin"], r["stop"], r["tokens"], r["target"]) for r in rows]
            earlier = sum(r["part"] == REPEATED for r in rows)
            for k, (text, new_at, spans, n) in enumerate(windows(turns, earlier, system, budget, history, rows[0]["place"] == 0)):
                out.append((None if orphan else conv, chapter, k, text, new_at, [{"begin": a, "stop": b} for a, b in spans], n))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


#: What a row is to its chapter: the retained system turn, a turn of the chapter before that serves as history, a turn of its own.
SYSTEM, REPEATED, OWN = 0, 1, 2

WINDOW_SCHEMA = "conv_id long, chapter long, window int, text string, new_at int, spans array<struct<begin:int,stop:int>>, n_tokens long"


def format_conversations(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, chapter_tokens: int = CHAPTER_TOKENS) -> DataFrame:
    """Windows (conv_id, chapter, window, text, new_at, spans, n_tokens) of turns(conv_id, turn, role, text).

    Each window holds the system turn (a conversation's first turn, if its role is
    system), earlier turns of at most `history` tokens, and from new_at on the
    new turns that fit the budget. spans are the characters that count for the
    loss: the texts of new assistant turns. Repeated turns are never in spans, so
    each assistant text is a target exactly once.

    Places and prefix sums of tokens are taken over the whole conversation,
    whatever its turn numbers. A chapter is the turns that begin within the same
    chapter_tokens of the prefix sum, and the unit that a task formats; its first
    window repeats as much history as any other. Windows end with their chapter.

    A system turn that leaves no room, or a turn beyond the budget, makes windows
    that exceed the budget: each has the system turn and one new turn, whole and without history.
    A null text is an empty one, a null role the role ''. Rows with a null turn come first;
    rows with equal turns are ordered by the first TIE_CHARS characters of role and text, then by hash, each a turn of its own. Rows with a null conv_id are
    one conversation. No rows give no windows; other columns are ignored.
    """
    if chapter_tokens < 2 * max(budget, history):
        raise ValueError("a chapter must hold two budgets")
    rows = placed(turns, tokenizer).withColumn("chapter", F.floor(F.col("before") / chapter_tokens).cast("long"))
    keys = ["orphan", "conv_id", "chapter"]
    begins = rows.groupBy(*keys).agg(F.min("before").alias("from"))
    # a turn near its chapter's end also goes to the next one; if that is empty, the turn between is longer than any history
    late = rows.filter(F.col("before") >= (F.col("chapter") + 1) * chapter_tokens - history).withColumn("chapter", F.col("chapter") + 1)
    late = late.join(begins, keys).filter(F.col("from") - F.col("before") <= history).drop("from")
    first = rows.filter("place = 0 and system").drop("chapter")
    heads = first.join(begins.select(*keys), ["orphan", "conv_id"])
    columns = [*keys, "part", "place", "form", "begin", "stop", "tokens", "target"]
    parts = [x.withColumn("part", F.lit(k)).select(*columns) for x, k in ((heads, SYSTEM), (late, REPEATED), (rows, OWN))]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ordered = everything.repartition(common.partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys, "part", "place")
    return ordered.mapInArrow(_format(budget, history), WINDOW_SCHEMA)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def each() -> Iterator[tuple]:
        begun, conv = False, None
        for batch in batches:
            for w in batch.to_pylist():
                if not begun or w["conv_id"] != conv:
                    if begun:
                        yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted
                    begun, conv, n, chars, formatted = True, w["conv_id"], 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse_turns(w["text"][w["new_at"] :]):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in w["spans"]:
                    text = unescape(w["text"][s["begin"] : s["stop"]])
                    loss.update(text.encode("utf-8"))
                    chars += len(text)
                formatted += len(w["text"])
        if begun:
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    out: list[tuple] = []
    for row in each():
        out.append(row)
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the windows finds, by conversation.

    A hash of a whole conversation can only be taken in order, by one task; texts
    are hashed as they stream by, never gathered.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    n = common.partitions(formatted.sparkSession)
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "chapter", "window")
    return ordered.mapInArrow(_digest, schema)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(common.stored(format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json")), "op8-windows"))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
