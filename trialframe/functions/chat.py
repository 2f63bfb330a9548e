"""Chat serialisation, response masks and preference texts over arrays of (role, content) messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chat format.
TOOLS_HEAD = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
RESPONSE_MARK = OPEN + "assistant\n"
ROLES = ("system", "user", "assistant", "tool")
IGNORED = -100


def block(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(OPEN), role, F.lit("\n"), content, F.lit(CLOSE + "\n"))


def render(messages: Column, generation_prompt: bool = False) -> Column:
    """The conversation as one text.

    A leading system message opens it, else the default one. Neighbouring ``tool`` messages share one user
    block. Messages of unknown roles give nothing, though they part the tool messages around them.
    """
    first = F.get(messages, F.lit(0))
    leads = F.coalesce(first["role"] == "system", F.lit(False))
    head = block("system", F.when(leads, first["content"]).otherwise(F.lit(DEFAULT_SYSTEM)))

    def one(m: Column, i: Column) -> Column:
        before, after = F.get(messages, i - 1)["role"], F.get(messages, i + 1)["role"]
        opens = (i == 0) | ~F.coalesce(before == "tool", F.lit(False))
        closes = ~F.coalesce(after == "tool", F.lit(False))
        tool = F.concat(
            F.when(opens, OPEN + "user").otherwise(""), F.lit("\n<tool_response>\n"), m["content"],
            F.lit("\n</tool_response>"), F.when(closes, CLOSE + "\n").otherwise(""),
        )
        plain = m["role"].isin("user", "assistant") | ((m["role"] == "system") & (i > 0))
        return F.when(m["role"] == "tool", tool).when(plain, block(m["role"], m["content"])).otherwise("")

    body = F.array_join(F.transform(messages, one), "")
    return F.concat(head, body, F.lit(RESPONSE_MARK if generation_prompt else ""))


def render_with_tools(messages: Column, tools: Column, generation_prompt: bool = False) -> Column:
    """As ``render``, for messages with ``tool_calls`` (array of struct name, arguments as JSON text) and declared ``tools`` (array of JSON texts)."""
    first = F.get(messages, F.lit(0))
    leads = F.coalesce(first["role"] == "system", F.lit(False))
    system = F.when(leads, first["content"]).otherwise(F.lit(DEFAULT_SYSTEM))
    declared = F.concat(
        F.lit(TOOLS_HEAD),
        F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), ""),
        F.lit(TOOLS_TAIL),
    )
    head = block("system", F.concat(system, F.when(F.size(tools) > 0, declared).otherwise("")))

    def calls(m: Column) -> Column:
        one = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
        said = F.when(F.coalesce(m["content"], F.lit("")) != "", F.concat(F.lit("\n"), m["content"])).otherwise("")
        return F.concat(F.lit(OPEN + "assistant"), said, F.array_join(F.transform(m["tool_calls"], one), ""), F.lit(CLOSE + "\n"))

    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))

    def one(m: Column, i: Column) -> Column:
        before, after = F.get(plain, i - 1)["role"], F.get(plain, i + 1)["role"]
        tool = F.concat(
            F.when((i == 0) | ~F.coalesce(before == "tool", F.lit(False)), OPEN + "user").otherwise(""), F.lit("\n<tool_response>\n"), m["content"],
            F.lit("\n</tool_response>"), F.when(~F.coalesce(after == "tool", F.lit(False)), CLOSE + "\n").otherwise(""),
        )
        called = (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
        said = m["role"].isin("user", "assistant") | ((m["role"] == "system") & (i > 0))
        return F.when(m["role"] == "tool", tool).when(called, calls(m)).when(said, block(m["role"], m["content"])).otherwise("")

    return F.concat(head, F.array_join(F.transform(messages, one), ""), F.lit(RESPONSE_MARK if generation_prompt else ""))


def response_start(text: Column, mark: str = RESPONSE_MARK) -> Column:
    """0-based place after the first response mark, -1 where there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, at - 1 + len(mark)).otherwise(-1)


def mask_labels(ids: Column, template: Column, length: Column | None = None) -> Column:
    """``ids`` with everything before the end of the first ``template`` and all padding (from ``length`` on) ignored.

    If the template does not occur, only padding is ignored.
    """
    pad = F.lit(None).cast("int") if length is None else length

    def masked(start: Column) -> Column:
        return F.transform(ids, lambda x, i: F.when((i < start) | F.coalesce(i >= pad, F.lit(False)), F.lit(IGNORED)).otherwise(x.cast("int")))

    return bound(template_end(ids, template), masked)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` bound to a lambda's variable: it is worked out once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def template_end(ids: Column, template: Column) -> Column:
    """0-based place after the first occurrence of ``template`` in ``ids``; 0 where there is none."""
    n = F.size(template)
    # A slice is made only where the first element fits; one that is cut off by the end equals no template.
    here = F.transform(ids, lambda x, i: F.when(x == F.get(template, F.lit(0)), F.slice(ids, i + 1, n) == template).otherwise(F.lit(False)))
    found = F.array_position(here, True)
    return F.when(found > 0, found - 1 + n).otherwise(F.lit(0)).cast("int")


def truncate(ids: Column, most: int = 1024) -> Column:
    return F.slice(ids, 1, most)


def pad(ids: Column, size: Column, token: int = 0, side: str = "right") -> Column:
    more = F.array_repeat(F.lit(token), (size - F.size(ids)).cast("int"))
    return F.concat(ids, more) if side == "right" else F.concat(more, ids)


def gather_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``key, messages`` with the turns of each conversation in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


def preference_text(pairs: DataFrame) -> DataFrame:
    """``prompt, chosen, rejected`` texts of preference pairs (chosen and rejected are system, user, assistant)."""
    asked = F.array(F.struct(F.lit("system").alias("role"), F.get("chosen", F.lit(0))["content"].alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    answer = lambda c: F.concat(F.get(c, F.lit(2))["content"], F.lit(CLOSE))
    return pairs.select(render(asked, True).alias("prompt"), answer("chosen").alias("chosen"), answer("rejected").alias("rejected"))
