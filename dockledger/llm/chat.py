"""Conversations as training windows: whole turns within a token budget, and which characters to learn."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.llm.marks import check_marks
from dockledger.operators.skew import hot_keys, positions

# Turns of a conversation that are cut into windows together. Windows end where a block ends.
BLOCK_TURNS = 256
# Tokens counted for the marks and the role of a turn.
TURN_TOKENS = 4
TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"


@dataclass(frozen=True)
class Template:
    r"""How a turn is written: begin, role, a newline, text, end.

    A backslash after its first character marks every control string inside a text or role, the template's own
    and those ``reserved``; one that already has backslashes there gets one more, so taking one
    away gives the text back. A newline in a role is written ``\n``, a backslash ``\\``.
    """

    begin: str = "<s>"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __post_init__(self):
        check_marks(self.marks)
        if "\\" in "".join(self.marks) or "\n" in "".join(self.marks):
            raise ValueError("control strings must not hold backslashes or newlines")

    @property
    def marks(self) -> list[str]:
        return [self.begin, self.end, *self.reserved]

    def _places(self, backslash: str) -> str:
        """A pattern for the places after a control string's first character."""
        return "|".join(
            rf"(?<={re.escape(m[0])}){backslash}(?=\\*{re.escape(m[1:])})" for m in self.marks
        )

    def escape(self, text: Column) -> Column:
        """Only text with a mark's first character is searched."""
        some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in sorted({m[0] for m in self.marks})])
        return F.when(some, F.regexp_replace(text, self._places(""), r"\\")).otherwise(text)

    def unescape(self, text: Column) -> Column:
        marked = F.contains(text, F.lit("\\"))
        return F.when(marked, F.regexp_replace(text, self._places(r"\\"), "")).otherwise(text)

    def role(self, role: Column) -> Column:
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def plain_role(self, written: Column) -> Column:
        plain = F.regexp_replace(self.unescape(written), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def count_tokens(text: str | Column) -> Column:
    """Runs of letters, single digits and other marks: about what a word tokenizer makes of a text."""
    return F.regexp_count(text, F.lit(TOKEN))


def format_windows(
    turns: DataFrame, budget: int = 1024, history: int = 256, template: Template = Template(),
    tokens: Column | None = None, block: int = BLOCK_TURNS,
) -> DataFrame:
    """The turns of each conversation as windows of whole turns, of at most ``budget`` tokens.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Prefix sums of the turns' tokens
    choose the windows: each starts at the first turn that no window has yet, repeats in front
    of it the last whole turns of up to ``history`` tokens, and before those the conversation's first
    turn if that is a system turn, and takes new turns while they fit. A turn that does not fit a window of its own
    still gets one, over the budget; turns are never cut. Repeated turns are
    context: only assistant turns that are new in a window are in its loss spans, so
    each of them is learned once. ``tokens`` is the caller's own count for a row, null for 0.

    Returns conv_id, first_turn and last_turn (positions from 1 of the new turns), n_repeated, tokens, text
    and loss, an array of (start, end) in code points of the text.

    Rows go by turn, then role, then text, nulls first; equal rows each stay. A null role or text is the empty one,
    a null conv_id one conversation of its own, an empty table gives no rows.

    A conversation of any length is cut every ``block`` turns, where a window ends too; each block brings copies
    of the turns before it that its history may need, and of the system turn. So a task
    works on one block: that many whole texts. Rows of a hot conversation are numbered across tasks.
    """
    if budget < 1 or not 0 <= history < budget or block < 1:
        raise ValueError("needs a positive budget, a history below it and a positive block")
    count = count_tokens("text") if tokens is None else F.coalesce(tokens, F.lit(0))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.withColumns({"role": role, "text": text}).select(
        "conv_id", "turn", "role", "text", (F.greatest(count, F.lit(0)) + TURN_TOKENS).cast("long").alias("cost")
    )
    hot = hot_keys(rows, ["conv_id"])
    made = [(rows, {})]
    if hot:
        known = F.xxhash64("conv_id").isin(list(hot))
        made = [(rows.where(~known), {}), (rows.where(known), hot)]
    parts = [
        _windows(positions(some, ["conv_id"], ["turn", "role", "text"], "at", "n", hot=keys), budget, history, template, block)
        for some, keys in made
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _windows(rows: DataFrame, budget: int, history: int, template: Template, block: int) -> DataFrame:
    """Windows of turns that are numbered by ``at`` in conversations of ``n`` turns."""
    head = (F.col("at") == 1) & (F.col("role") == "system")
    written_role, written = template.role(F.col("role")), template.escape(F.col("text"))
    piece = F.concat(F.lit(template.begin), written_role, F.lit("\n"), written, F.lit(template.end))
    turns = rows.select(
        "conv_id", "at", "n", "cost", head.alias("head"), (F.col("role") == "assistant").alias("learn"),
        piece.alias("piece"), (F.length(written_role) + len(template.begin) + 1).alias("lead"),
    )
    turns = turns.withColumn("chars", F.length("piece"))

    # Where a turn is needed: its own block, the next one's history, every later block for the system turn.
    reach = history // TURN_TOKENS
    mine, last = (F.floor((F.col(c) - 1) / block).cast("int") for c in ("at", "n"))
    later = F.least(last, F.floor((F.col("at") - 1 + reach) / block).cast("int"))
    until = F.when(F.col("head"), last).otherwise(later)
    placed = turns.withColumn("block", F.explode(F.sequence(mine, F.greatest(mine, until)))).withColumn(
        "new", F.col("block") == mine
    )

    group = Window.partitionBy("conv_id", "block")
    in_turn = group.orderBy("at")
    own = F.when(F.col("head"), 0).otherwise(F.col("cost"))
    summed = placed.withColumns({
        "until": F.sum(own).over(in_turn.rowsBetween(Window.unboundedPreceding, 0)),
        "system": F.max(F.when(F.col("head"), F.col("cost")).otherwise(0)).over(group),
    }).withColumn("since", F.col("until") - own)
    before = F.min(F.when(~F.col("head"), F.col("since"))).over(group.orderBy("since").rangeBetween(-history, -1))
    summed = summed.withColumn("past", F.col("since") - F.coalesce(before, F.col("since")))

    fields = ["at", "new", "head", "learn", "since", "until", "past", "system", "chars", "lead", "piece"]
    blocks = summed.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
    # Greedy: a turn that ends past the room of the window that is open starts the next one.
    none = F.array().cast("array<struct<at: bigint, past: bigint>>")
    opened = F.aggregate(
        F.filter("turns", lambda t: t["new"]),
        F.struct(none.alias("starts"), F.lit(-1).cast("long").alias("full")),
        lambda state, t: F.when(t["until"] <= state["full"], state).otherwise(
            F.struct(
                F.concat(state["starts"], F.array(F.struct(t["at"].alias("at"), t["past"].alias("past")))).alias("starts"),
                F.greatest(t["until"], t["since"] + budget - t["system"] - t["past"]).alias("full"),
            )
        ),
        lambda state: state["starts"],
    )
    windows = blocks.withColumn("starts", opened).select(
        "conv_id", "turns", "starts", F.posexplode("starts").alias("i", "start")
    )
    following = F.coalesce(F.try_element_at("starts", F.col("i") + 2)["at"], F.lit(1 << 62))
    windows = windows.select("conv_id", "turns", "start", following.alias("stop"))
    since = F.filter("turns", lambda t: t["at"] == F.col("start.at"))[0]["since"]
    windows = windows.withColumn("reach", since - F.col("start.past"))
    chosen = F.filter(
        "turns",
        lambda t: t["head"] & (t["at"] < F.col("stop"))
        | (t["at"] >= F.col("start.at")) & (t["at"] < F.col("stop"))
        | ~t["head"] & (t["at"] < F.col("start.at")) & (t["since"] >= F.col("reach")),
    )
    windows = windows.select("conv_id", "start", chosen.alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans")),
        lambda state, t: F.struct(
            (state["at"] + t["chars"]).alias("at"),
            F.when(
                t["learn"] & (t["at"] >= F.col("start.at")),
                F.concat(state["spans"], F.array(F.struct(
                    (state["at"] + t["lead"]).alias("start"),
                    (state["at"] + t["chars"] - len(template.end)).alias("end"),
                ))),
            ).otherwise(state["spans"]).alias("spans"),
        ),
        lambda state: state["spans"],
    )
    used = F.aggregate(
        "turns", F.lit(0).cast("long"),
        lambda n, t: n + F.when(t["head"], t["system"]).otherwise(t["until"] - t["since"]),
    )
    return windows.select(
        "conv_id", F.col("start.at").alias("first_turn"), F.element_at("turns", -1)["at"].alias("last_turn"),
        F.size(F.filter("turns", lambda t: t["at"] < F.col("start.at"))).alias("n_repeated"), used.alias("tokens"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), spans.alias("loss"),
    )


def read_window(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """Windows with ``turns``, an array of (role, text) read back from the text, repeated ones included."""
    written = F.slice(F.split("text", re.escape(template.end)), 1, F.size(F.split("text", re.escape(template.end))) - 1)
    parts = F.transform(written, lambda w: F.split(F.substring(w, len(template.begin) + 1, 1 << 30), "\n", 2))
    turns = F.transform(parts, lambda p: F.struct(template.plain_role(p[0]).alias("role"), template.unescape(p[1]).alias("text")))
    return windows.withColumn("turns", turns)


def learned(template: Template = Template()) -> Column:
    """The texts under a window's loss spans, unescaped."""
    return F.transform("loss", lambda s: template.unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))


def read_turns(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, position, role and text of each turn, once, read back from the windows."""
    new = F.slice("turns", F.col("n_repeated") + 1, F.size("turns"))
    rows = read_window(windows, template).select("conv_id", "first_turn", F.posexplode(new).alias("i", "turn"))
    return rows.select("conv_id", (F.col("first_turn") + F.col("i")).alias("position"), "turn.role", "turn.text")


def format_report(turns: DataFrame, budget: int = 1024, history: int = 256, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, all read back from its windows.

    The digests of a conversation need its whole text in one row; the windows themselves do not.
    """
    read = read_window(format_windows(turns, budget, history, template), template)
    new = F.slice("turns", F.col("n_repeated") + 1, F.size("turns"))
    each = read.select(
        "conv_id", "first_turn", F.size(new).alias("n"), F.length("text").alias("chars"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("body"),
        F.array_join(learned(template), "").alias("loss"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("first_turn", "body", "loss"))).alias("parts"),
    )
    body, loss = (F.array_join(F.col(f"parts.{c}"), "").alias(c) for c in ("body", "loss"))
    return whole.select("conv_id", "n_turns", "formatted_chars", body, loss).select(
        "conv_id", "n_turns", F.sha2(F.col("body").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
