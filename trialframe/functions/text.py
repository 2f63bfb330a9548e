"""Text expressions: code fences, JSON lines, padding, number formats, list rendering."""

from __future__ import annotations

import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?is)```(?:python)?\s*(.*?)\s*```"
#: Unicode white space at either end; ``trim`` would take away spaces only.
EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def extract_code(c: Column) -> Column:
    """Content of the last fenced block, stripped; the stripped text where there is no block."""
    found = F.regexp_extract_all(c, F.lit(FENCE), F.lit(1))
    return strip(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(c))


def fenced(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), code, F.lit("\n```"))


def fence_unless_fenced(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("```")), text).otherwise(fenced(text))


def last_json_line(stdout: Column, schema: str) -> Column:
    """The last line that looks like a JSON object and parses, as a struct; null if there is none."""
    lines = F.filter(F.split(stdout, "\n"), lambda x: F.startswith(F.trim(x), F.lit("{")) & F.endswith(F.trim(x), F.lit("}")))
    wrapped = F.transform(lines, lambda x: F.get_json_object(x, "$"))
    good = F.filter(wrapped, lambda x: x.isNotNull())
    return F.from_json(F.get(good, F.size(good) - 1), schema)


def padded(prefix: Column, number: Column) -> Column:
    """``prefix_00042``; numbers of six and more digits stay whole."""
    return F.format_string("%s_%05d", prefix, number)


def python_list(items: Column) -> Column:
    """``['a', 'b']``."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))


def indented(lines: Column, spaces: int = 4) -> Column:
    """Each line of a text moved right."""
    return F.array_join(F.transform(F.split(lines, "\n"), lambda x: F.concat(F.lit(" " * spaces), x)), "\n")


def filled(template: Column | str, **values: Column) -> Column:
    """``template`` with each literal ``{name}`` replaced by the value of that name, whatever the value holds."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def number_texts(value: Column) -> Column:
    """``value`` in the formats that reports use, as a struct: one, two, three and four decimals and an exponent with four."""
    return F.struct(*[F.format_string(f, value).alias(n) for n, f in (("f1", "%.1f"), ("f2", "%.2f"), ("f3", "%.3f"), ("f4", "%.4f"), ("e4", "%.4e"))])


def normal_quantile(p: float) -> float:
    return statistics.NormalDist().inv_cdf(p)
