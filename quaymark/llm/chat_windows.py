"""Chat formatting in budgeted windows [native].

A conversation becomes one or more windows of whole turns.  Prefix sums of turn tokens over the
conversation choose the windows.  The first takes the turns that end within the budget.  Behind it the tokens
are laid on a grid whose step is a third of what the budget leaves beside the system turn, and a turn belongs
to the grid cell in which it ends: new turns take two steps at most and the history the rest, so that a window
keeps to the budget unless one turn alone is longer than a step (`over_budget`); turns are never cut.  Each
further window starts with the system turn and up to `history` turns before it; these are repeats, and only
new assistant turns lie under the loss mask, so each target is trained on once.

Template: a turn is `<|role|>text</s>`.  In roles and texts `\\`, `<`, `>`, `[` are written `\\s`, `\\l`,
`\\g`, `\\b`, so that no control string can stand inside a turn and the escape can be undone.

Defined cases: a null text or role is empty; a null conv_id is a conversation, a null turn comes first;
turns of equal number go by role, then text; repeated rows are turns of their own; the system turn is the
first turn if its role is `system`; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import WORD

#: Fixed values of the template: what stands for each character that could start or end a mark.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"))
TURN_END = "</s>"
#: Marks of one turn count as so many tokens.
MARK_TOKENS = 4


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + MARK_TOKENS)


def windows(conversations: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """(conv_id, window, formatted, loss_spans, n_repeated, n_new, tokens, over_budget): the training windows.

    `loss_spans` are (start, length) in characters of `formatted`; `n_repeated` turns at its start are repeats.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = _turns(conversations)
    rows = rows.withColumn("i", F.row_number().over(conv) - 1).withColumn("system", (F.col("i") == 0) & (F.col("role") == "system"))
    fixed = F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)
    rows = rows.withColumn("rest", F.lit(budget) - fixed).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("rest") / 3)))
    rows = rows.withColumn("end", F.sum("tokens").over(conv.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("cell", F.when(F.col("end") <= budget, F.lit(0)).otherwise(1 + F.floor((F.col("end") - budget - 1) / F.col("step"))))
    rows = rows.withColumn("head", F.coalesce(F.lag("cell").over(conv) != F.col("cell"), F.lit(True)))
    rows = rows.withColumn("window", (F.sum(F.col("head").cast("int")).over(conv.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    # a turn is history of each later window that starts at most `history` turns and rest - 2 * step tokens after it starts
    room, begin = F.col("rest") - 2 * F.col("step"), F.col("end") - F.col("tokens")
    later = [F.when(F.lead("head", d).over(conv) & (F.lead(begin, d).over(conv) - begin <= room), F.lead("window", d).over(conv)) for d in range(1, history + 1)]
    rows = rows.withColumn("later", F.filter(F.array(*later).cast("array<int>"), lambda w: w.isNotNull()))
    rows = rows.withColumn("windows_of_conv", F.max("window").over(whole))
    all_later = F.when(F.col("windows_of_conv") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("windows_of_conv")))).otherwise(F.array().cast("array<int>"))
    goes = F.concat(F.array("window"), F.when(F.col("system"), all_later).otherwise(F.col("later")))
    formatted = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"), escape(F.col("text")), F.lit(TURN_END))
    rows = rows.withColumn("formatted", formatted).withColumn("before_text", F.length(F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))))
    dealt = rows.select("conv_id", F.col("window").alias("own"), F.explode(goes).alias("window"), "i", "role", "formatted", "before_text", "tokens")
    item = F.struct("i", (F.col("own") != F.col("window")).alias("repeat"), (F.col("role") == "assistant").alias("target"), "formatted", "before_text", F.length("formatted").alias("size"))
    out = dealt.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(item)).alias("p"), F.sum("tokens").alias("tokens"))
    out = out.withColumn("formatted", F.array_join(F.transform("p", lambda x: x["formatted"]), ""))
    # where each turn starts: running sums of sizes, as long as the window has turns
    starts = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list")), lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list")))["list"]
    spans = F.zip_with("p", starts, lambda x, at: F.when(x["target"] & ~x["repeat"], F.struct((at + x["before_text"]).alias("start"), (x["size"] - x["before_text"] - len(TURN_END)).alias("length"))))
    out = out.withColumn("loss_spans", F.filter(spans, lambda s: s.isNotNull()))
    repeated = F.size(F.filter("p", lambda x: x["repeat"]))
    return out.select("conv_id", "window", "formatted", "loss_spans", repeated.alias("n_repeated"), (F.size("p") - repeated).alias("n_new"), "tokens", (F.col("tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and targets of whole conversations, read from the windows alone.

    (conv_id, turns, loss_texts, formatted_chars); turns are (role, text) in order.  A conversation comes
    back as one row, as it must.
    """
    parts = F.filter(F.split("formatted", TURN_END, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        mark = F.substring_index(x, "|>", 1)
        return F.struct(unescape(F.substr(mark, F.lit(3))).alias("role"), unescape(F.substr(x, F.length(mark) + 3)).alias("text"))

    new = F.transform(F.slice(parts, F.col("n_repeated") + 1, F.col("n_new")), turn)
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    rows = formatted.select("conv_id", "window", new.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("n"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("formatted_chars"))
    return out.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss_texts"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
