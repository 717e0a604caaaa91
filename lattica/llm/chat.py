"""Chat formatting in budgeted windows of turns."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored

#: Control strings of the templates that a formatted text may meet. Only "<s>" and "</s>" are used here.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CODE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.S)

#: Turns whose prefix sums are formed together: sums of blocks first, then of turns within a block.
BLOCK_TURNS = 256


def escaped(text: str, one_line: bool = False) -> str:
    r"""``text`` with ``\`` doubled and every control string broken by ``\-``; a role's line ends become ``\n``."""
    out = _CONTROL.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text.replace("\\", "\\\\"))
    return out.replace("\n", "\\n") if one_line else out


def unescaped(text: str) -> str:
    return _CODE.sub(lambda m: {"-": "", "n": "\n"}.get(m[1], m[1]), text)


def assembled(turns: list[tuple[bool, str, str]]) -> tuple[str, int, list[dict[str, int]]]:
    """Text of a window from (new, role, text) in order, where its new turns begin, and spans under the loss.

    Only new assistant texts are under the loss; whatever a window repeats is context.
    """
    parts, at, begin, spans = [], 0, None, []
    for new, role, text in turns:
        head, body = f"<s>{escaped(role, True)}\n", escaped(text)
        if new:
            begin = at if begin is None else begin
            if role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), at if begin is None else begin, spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def formatted(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of the conversations (conv_id, turn, role, text): conv_id, window, n_tokens, formatted, new_from, loss.

    A turn counts (characters of role and text) / 4, rounded up, plus 4 tokens. Prefix sums of these
    counts lay a conversation's turns (by turn, then role, then text; nulls first) on a line, which is cut
    every ``room`` tokens, room being what the budget leaves beside the system turn and the history (half of what it leaves beside
    the system turn, at least). Turns within one stretch are the new turns of a window. A turn across a cut goes with the stretch before it
    if both have room, else with the one after it if that has, else it is a window of its own, as is a turn
    longer than the room. Whether it fits follows from the sums at the two nearest cuts, so every turn is new in exactly one window
    and no conversation is scanned in order.

    Each window begins with the system turn (the first turn, if its role is system), then repeats as many of the turns before
    its first new one as start within ``history`` tokens and fit. A window never exceeds the budget unless
    its only new turn, with the system turn, does.

    Null roles and texts are empty; a null conv_id is a conversation like any other, null turns come first. Repeated rows
    are turns of their own; turns equal in turn, role and text are interchangeable. A text of any length is one turn, never cut. Other
    columns take no part, whatever their names; an empty table has no windows. ``loss`` holds spans of ``formatted`` in characters. A window's turns meet in one
    task; the budget bounds them. Prefix sums never meet in one: blocks of turns are summed first. Turns with their places, and where they are laid, are written once
    and read from there.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS))
    rows = rows.withColumn("tokens", (F.ceil((F.length("role") + F.length("text")) / 4) + 4).cast("bigint"))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("s"), F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    over_blocks = by_block.rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("s").over(over_blocks), F.lit(0)).alias("tokens_ahead"),
        F.coalesce(F.sum("n").over(over_blocks), F.lit(0)).alias("turns_ahead"),
        F.sum("s").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"),
    )
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.withColumn("own", F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nth", F.row_number().over(inner) - 1)
    placed = placed.join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(
        "conv_id", "role", "text", "tokens", "all_tokens", (F.col("turns_ahead") + F.col("nth")).alias("pos"), (F.col("tokens_ahead") + F.coalesce("own", F.lit(0))).alias("start")
    )
    placed = stored(placed, "turns")
    system = placed.filter((F.col("pos") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("c"), F.col("tokens").alias("system_tokens"))
    laid = placed.select("conv_id", "pos", "start", "tokens", "all_tokens").join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    laid = laid.withColumn("system_tokens", F.coalesce("system_tokens", F.lit(0)))
    left = F.lit(budget) - F.col("system_tokens")
    laid = laid.withColumn("room", F.greatest(left - history, F.floor(left / 2), F.lit(1)).cast("bigint"))
    laid = laid.withColumn("stretch", F.floor(F.col("start") / F.col("room"))).withColumn("last", F.floor((F.col("start") + F.col("tokens") - 1) / F.col("room")))
    laid = stored(laid, "laid")
    across = laid.filter("last > stretch").withColumn("before", (F.col("stretch") + 1) * F.col("room") - F.col("start")).withColumn("beyond", F.col("start") + F.col("tokens") - F.col("last") * F.col("room"))
    earlier = across.select(F.col("conv_id").alias("c"), F.col("last").alias("t"), F.col("beyond").alias("beyond_earlier"))
    later = across.select(F.col("conv_id").alias("c"), (F.col("stretch") - 1).alias("t"), F.col("before").alias("before_later"), (F.col("tokens") <= F.col("room")).alias("fits_later"), F.col("beyond").alias("beyond_later"))
    there = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("t"))
    met = across.join(earlier, there, "left").drop("c", "t").join(later, there, "left").drop("c", "t")
    with_last = F.col("beyond") <= F.coalesce("beyond_earlier", F.lit(0))
    taken = F.coalesce(F.col("fits_later") & (F.col("beyond_later") <= F.col("beyond")), F.lit(False))
    spare = F.coalesce("before_later", F.greatest(F.lit(0), (F.col("stretch") + 2) * F.col("room") - F.col("all_tokens")))
    side = F.when(F.col("tokens") > F.col("room"), 1).when(with_last, 0).when(~taken & (F.col("before") <= spare), 2).otherwise(1)
    columns = ["conv_id", "pos", "start", "tokens", "system_tokens", "room", "stretch"]
    laid = laid.filter("last = stretch").select(*columns, (F.col("stretch") * 2).alias("window")).unionByName(met.select(*columns, (F.col("stretch") * 2 + side).alias("window")))
    laid = stored(laid, "windows")
    windows = laid.groupBy("conv_id", "window").agg(
        F.min("start").alias("first"), F.min("pos").alias("first_pos"), F.sum("tokens").alias("own"), F.max("system_tokens").alias("has_system"), F.max("room").alias("most")
    )
    windows = windows.withColumn("reach", F.least(F.lit(history), F.col("most"), F.lit(budget) - F.col("has_system") - F.col("own")))
    new = laid.select("conv_id", "window", "pos", F.lit(True).alias("new"))
    before = laid.filter((F.col("pos") > 0) | (F.col("system_tokens") == 0)).select(F.col("conv_id").alias("c"), "pos", "start", F.explode(F.array(*[F.col("stretch") * 2 + k for k in (1, 2, 3, 4)])).alias("w"))
    near = (F.col("start") < F.col("first")) & (F.col("start") >= F.col("first") - F.col("reach"))
    repeated = windows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")) & near).select("conv_id", "window", "pos", F.lit(False).alias("new"))
    kept = windows.filter((F.col("first_pos") > 0) & (F.col("has_system") > 0)).select("conv_id", "window", F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("new"))
    members = new.unionByName(repeated).unionByName(kept).withColumnRenamed("conv_id", "c").withColumnRenamed("pos", "p")
    texts = members.join(placed, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("pos")))
    each = texts.groupBy("conv_id", "window").agg(F.sum("tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", "new", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            done = [assembled([(t["new"], t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column("turns")]
            text, begin, spans = zip(*done, strict=True) if done else ((), (), ())
            new = [pa.array(text, pa.string()), pa.array(begin, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "window", "n_tokens")] + new, names=["conv_id", "window", "n_tokens", "formatted", "new_from", "loss"])

    return mapped(each, run, "conv_id long, window long, n_tokens long, formatted string, new_from long, loss array<struct<start:long,end:long>>")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted``'s output: number and digest of the turns, length and digest of
    all text under the loss, length of all formatted text. Windows stream by in order; only running hashes are kept."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        own, sums = None, None

        def close():
            n, turns, chars, loss, size = sums
            return {"conv_id": own, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv, text = batch.column("conv_id")[i].as_py(), batch.column("formatted")[i].as_py()
                if sums is None or conv != own:
                    if sums is not None:
                        done.append(close())
                    own, sums = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text[batch.column("new_from")[i].as_py() :]):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{said}\n".encode())
                for span in batch.column("loss")[i].as_py():
                    under = unescaped(text[span["start"] : span["end"]])
                    sums[2] += len(under)
                    sums[3].update(under.encode())
                sums[4] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
        if sums is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=_DIGEST)

    ordered = windows.select("conv_id", "window", "formatted", "new_from", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return mapped(ordered, run, schema)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
