"""Parametric (prompt, program) synthesis: six generators over hash draws, and rejection sampling.

Programs are plain Python that leave a list of experiments (dicts of factor to levels by trial) in
``experiments``, the convention of the grader's default dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import digest, draw, pick
from ..sources.shared import kept
from ..functions.text import filled, python_list
from .ordering import numbered

# Factor vocabularies, task pairs and stimuli.
PERCEPTUAL = {
    "color": ["red", "green", "blue", "yellow"], "shape": ["circle", "square", "triangle", "diamond"], "orientation": ["up", "down", "left", "right"],
    "size": ["small", "medium", "large"], "contrast": ["low", "medium", "high"], "spatial_frequency": ["low_freq", "mid_freq", "high_freq"],
    "motion_direction": ["leftward", "rightward", "upward", "downward"], "luminance": ["dark", "neutral", "bright"],
}
COGNITIVE = {
    "word_text": ["red", "green", "blue", "yellow"], "font_color": ["red", "green", "blue", "yellow"], "target_direction": ["left", "right"],
    "flanker_direction": ["left", "right"], "task_type": ["color_naming", "word_reading"], "modality": ["visual", "auditory"],
    "valence": ["positive", "neutral", "negative"], "arousal": ["low", "high"], "cue_validity": ["valid", "invalid", "neutral"],
    "stimulus_location": ["left_visual_field", "right_visual_field"], "response_hand": ["left_hand", "right_hand"], "memory_load": ["low_load", "high_load"],
    "feedback_type": ["reward", "punishment", "none"], "digit_value": ["one", "two", "three", "four"], "letter_case": ["uppercase", "lowercase"],
}
TASKS = [["color_task", "shape_task"], ["magnitude_judgment", "parity_judgment"], ["vowel_consonant", "case_judgment"]]
STIMULI = [("stimulus", ["letter_A", "letter_B"]), ("cue", ["left_cue", "right_cue"]), ("color", ["red", "blue"])]
SYSTEM = "You write complete, runnable Python that builds the trial sequences of the experiment that is asked for and leaves them in `experiments`."


#: Programs; names in braces are filled in. Other braces are Python's own.
CROSSING = """import itertools

factors = [
{lines}
]
cells = list(itertools.product(*[levels for _, levels in factors]))
least = {least}
while len(cells) < least:
    cells = cells + cells
experiments = [{name: [c[i] for c in cells] for i, (name, _) in enumerate(factors)}]
"""
CONGRUENCY = """levels = {levels}
same = [(x, x) for x in levels]
other = [(x, y) for x in levels for y in levels if x != y]
trials = []
while same or other:
    trials += other[:len(levels)]
    del other[:len(levels)]
    trials += same[:1]
    del same[:1]
experiments = [{'{first}': [x for x, _ in trials], '{second}': [y for _, y in trials], 'congruency': ['congruent' if x == y else 'incongruent' for x, y in trials]}]
"""
SWITCHING = """tasks = {tasks}
levels = {levels}
n = max({least}, 4)
task = [tasks[(i // 2) % 2] for i in range(n)]
experiments = [{'task': task, '{stimulus}': [levels[i % 2] for i in range(n)], 'task_transition': ['none'] + ['repeat' if a == b else 'switch' for a, b in zip(task, task[1:])]}]
"""
NBACK = """n, count = {n}, {least}
letters = [('A', 'B', 'C')[(i * i + i // 3) % 3] for i in range(count)]
experiments = [{'letter': letters, 'target': ['none'] * n + ['target' if x == y else 'lure' for x, y in zip(letters, letters[n:])]}]
"""
CONSTRAINED = """gone, pin = '{gone}', '{pin}'
cells = [(m, i) for m in ('visual', 'auditory', 'tactile') if m != gone for i in ('low', 'medium', 'high')]
cells.sort(key=lambda c: c[1] != pin)
experiments = [{'modality': [m for m, _ in cells], 'intensity': [i for _, i in cells]}]
"""
PARTIAL = CROSSING + """free = {free}
experiments[0]['{factor}'] = [free[i % len(free)] for i in range(len(cells))]
"""


def factor_table() -> Column:
    """All factors as an array of (name, levels), in vocabulary order."""
    both = [*PERCEPTUAL.items(), *COGNITIVE.items()]
    return F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, v)).alias("levels")) for n, v in both])


def _sampled(items: Column, n: Column | int, seed: int, *parts: Column | str) -> Column:
    """``n`` of ``items`` without replacement, in the order of their hashes."""
    keyed = F.transform(items, lambda x, i: F.struct(digest(seed, *parts, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["x"])


def _lines(factors: Column) -> Column:
    return F.array_join(F.transform(factors, lambda f: F.concat(F.lit("    ('"), f["name"], F.lit("', "), python_list(f["levels"]), F.lit("),"))), "\n")


def _described(factors: Column) -> Column:
    return F.array_join(F.transform(factors, lambda f: F.concat(F.lit("'"), f["name"], F.lit("' with levels "), python_list(f["levels"]))), ", ")


def factorial(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Two to four factors of two to four levels, fully crossed; least trials in four of ten."""
    a = F.col("attempt")
    n = draw(3, seed, a, "n") + 2
    chosen = _sampled(factor_table(), n.cast("int"), seed, a, "f")
    cut = F.transform(chosen, lambda f: F.struct(f["name"].alias("name"), _sampled(f["levels"], (F.lit(2) + digest(seed, a, "k", f["name"]) % F.least(F.lit(3), F.size(f["levels"]) - 1)).cast("int"), seed, a, "l", f["name"]).alias("levels")))
    some = draw(10, seed, a, "m") < 4
    rows = rows.withColumn("factors", cut).withColumn("least", F.when(some, pick([16, 24, 32, 48], seed, a, "t")).otherwise(0))
    asked = F.when(F.col("least") > 0, F.concat(F.lit(" Run at least "), F.col("least").cast("string"), F.lit(" trials."))).otherwise("")
    style = draw(3, seed, a, "p")
    told = _described(F.col("factors"))
    prompt = (
        F.when(style == 0, F.concat(F.lit("Create an experiment that fully crosses "), told, F.lit("."), asked))
        .when(style == 1, F.concat(F.lit("Write a script for a factorial design over "), F.size("factors").cast("string"), F.lit(" factors: "), told, F.lit("."), asked))
        .otherwise(F.concat(F.lit("Cross every level of "), told, F.lit(" and list the trials."), asked))
    )
    return rows.select(
        "attempt", F.lit("factorial_crossing").alias("task_family"), F.when(F.size("factors") == 2, "simple").otherwise("medium").alias("complexity"),
        F.when(F.col("least") > 0, F.array(F.lit("crossing"), F.lit("minimum_trials"))).otherwise(F.array(F.lit("crossing"))).alias("constraint_types"),
        prompt.alias("prompt"), filled(CROSSING, lines=_lines(F.col("factors")), least=F.col("least").cast("string")).alias("code"),
    )


def congruency(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Stroop, flanker or Simon tasks; the last are filed under flanker."""
    a = F.col("attempt")
    name = pick(["stroop", "flanker", "simon"], seed, a, "c")
    k = F.when(draw(10, seed, a, "m") < 6, pick([1, 2], seed, a, "k")).otherwise(0)
    rows = rows.withColumn("name", name).withColumn("k", k)
    levels = F.when(F.col("name") == "stroop", python_list(F.array(*map(F.lit, PERCEPTUAL["color"])))).otherwise(F.lit("['left', 'right']"))
    first = F.when(F.col("name") == "stroop", "word_text").when(F.col("name") == "flanker", "target_direction").otherwise("stimulus_location")
    second = F.when(F.col("name") == "stroop", "font_color").when(F.col("name") == "flanker", "flanker_direction").otherwise("response_hand")
    limit = F.when(F.col("k") > 0, F.concat(F.lit(" No more than "), F.col("k").cast("string"), F.lit(" congruent trials in a row."))).otherwise("")
    head = F.when(draw(2, seed, a, "p") == 0, F.lit("Build a ")).otherwise(F.lit("Write the trials of a "))
    prompt = F.concat(head, F.col("name"), F.lit(" task: cross '"), first, F.lit("' and '"), second, F.lit("' over "), levels, F.lit(" and mark congruent trials."), limit)
    code = filled(CONGRUENCY, levels=levels, first=first, second=second)
    types = F.when(F.col("k") > 0, F.array(F.lit("within_trial_derivation"), F.lit("at_most_k_in_a_row"))).otherwise(F.array(F.lit("within_trial_derivation")))
    return rows.select("attempt", F.when(F.col("name") == "stroop", "stroop_congruency").otherwise("flanker_task").alias("task_family"), F.lit("medium").alias("complexity"), types.alias("constraint_types"), prompt.alias("prompt"), code.alias("code"))


def _types(*names: str) -> Column:
    return F.array(*map(F.lit, names)).alias("constraint_types")


def task_switching(rows: DataFrame, seed: int = 42) -> DataFrame:
    a = F.col("attempt")
    tasks = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in TASKS]), (draw(3, seed, a, "a") + 1).cast("int"))
    stimulus = F.element_at(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, v)).alias("levels")) for n, v in STIMULI]), (draw(3, seed, a, "s") + 1).cast("int"))
    rows = rows.withColumn("tasks", python_list(tasks)).withColumn("s", stimulus).withColumn("most", pick([2, 3], seed, a, "r")).withColumn("least", pick([8, 12, 16], seed, a, "t"))
    levels, most, least = python_list(F.col("s.levels")), F.col("most").cast("string"), F.col("least").cast("string")
    prompt = F.concat(F.lit("Design a task-switching experiment: tasks "), F.col("tasks"), F.lit(", '"), F.col("s.name"), F.lit("' with levels "), levels, F.lit(". Derive repeat and switch from the task before. At most "), most, F.lit(" repeats in a row, at least "), least, F.lit(" trials."))
    code = filled(SWITCHING, tasks=F.col("tasks"), levels=levels, least=least, stimulus=F.col("s.name"))
    return rows.select("attempt", F.lit("task_switching_transition").alias("task_family"), F.lit("complex").alias("complexity"), _types("transition_derivation", "at_most_k_in_a_row", "minimum_trials"), prompt.alias("prompt"), code.alias("code"))


def nback(rows: DataFrame, seed: int = 42) -> DataFrame:
    a = F.col("attempt")
    rows = rows.withColumn("n", pick([1, 2], seed, a, "n").cast("string")).withColumn("least", pick([12, 18], seed, a, "t").cast("string"))
    prompt = F.concat(F.lit("Write a "), F.col("n"), F.lit("-back task over the letters ['A', 'B', 'C'] with at least "), F.col("least"), F.lit(" trials, and mark targets."))
    code = filled(NBACK, n=F.col("n"), least=F.col("least"))
    return rows.select("attempt", F.lit("nback_window").alias("task_family"), F.lit("complex").alias("complexity"), _types("window_derivation", "minimum_trials"), prompt.alias("prompt"), code.alias("code"))


def constrained(rows: DataFrame, seed: int = 42) -> DataFrame:
    a = F.col("attempt")
    rows = rows.withColumn("gone", pick(["visual", "auditory", "tactile"], seed, a, "x")).withColumn("pin", pick(["low", "medium", "high"], seed, a, "p"))
    prompt = F.concat(F.lit("Cross 'modality' (visual, auditory, tactile) with 'intensity' (low, medium, high), leave out "), F.col("gone"), F.lit(", and start with intensity "), F.col("pin"), F.lit("."))
    code = filled(CONSTRAINED, gone=F.col("gone"), pin=F.col("pin"))
    return rows.select("attempt", F.lit("constrained_design").alias("task_family"), F.lit("medium").alias("complexity"), _types("exclude", "pin", "at_most_k_in_a_row"), prompt.alias("prompt"), code.alias("code"))


def partial(rows: DataFrame, seed: int = 42) -> DataFrame:
    a = F.col("attempt")
    table = lambda names: F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, v)).alias("levels")) for n, v in names.items()])
    two = lambda f, part: F.struct(f["name"].alias("name"), _sampled(f["levels"], 2, seed, a, part, f["name"]).alias("levels"))
    rows = rows.withColumn("crossed", F.transform(_sampled(table(PERCEPTUAL), 2, seed, a, "f"), lambda f: two(f, "l")))
    rows = rows.withColumn("free", two(F.get(_sampled(table(COGNITIVE), 1, seed, a, "g"), F.lit(0)), "m"))
    prompt = F.concat(F.lit("Cross "), _described(F.col("crossed")), F.lit("; vary "), _described(F.array("free")), F.lit(" without crossing it."))
    code = filled(PARTIAL, lines=_lines(F.col("crossed")), least=F.lit("0"), free=python_list(F.col("free.levels")), factor=F.col("free.name"))
    return rows.select("attempt", F.lit("partial_crossing").alias("task_family"), F.lit("medium").alias("complexity"), _types("partial_crossing", "at_most_k_in_a_row"), prompt.alias("prompt"), code.alias("code"))


GENERATORS: tuple[Callable[..., DataFrame], ...] = (factorial, congruency, task_switching, nback, constrained, partial)


def attempts(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + n).withColumnRenamed("id", "attempt")


def samples(spark: SparkSession, n: int, seed: int = 42, first: int = 0) -> DataFrame:
    """``n`` attempts, each by one of the six generators with equal chance: ``attempt, task_family, complexity, constraint_types, prompt, code``."""
    rows = attempts(spark, n, first).withColumn("g", draw(len(GENERATORS), seed, F.col("attempt"), "generator"))
    parts = [g(rows.where(F.col("g") == i).drop("g"), seed) for i, g in enumerate(GENERATORS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_accepted(verified: DataFrame, n: int, split: str) -> DataFrame:
    """The first ``n`` rows with ``ok``, by ``attempt``, with ids ``split_00000`` on. Fewer than ``n`` raise."""
    top = numbered(verified.where("ok"), "attempt", name="seq").where(F.col("seq") < n)
    have = top.agg(F.count("*").alias("c")).select(F.when(F.col("c") < n, F.raise_error(F.lit(f"fewer than {n} accepted: make more attempts"))).otherwise(F.col("c")).alias("c"))
    return top.join(have).where("c >= 0").drop("c").withColumn("id", F.format_string(f"{split}_%05d", F.col("seq"))).withColumn("split", F.lit(split))


def verified_dataset(spark: SparkSession, n: int, base_seed: int, split: str, verify: Callable[[DataFrame], DataFrame], over: float = 1.5, rounds: int = 4) -> DataFrame:
    """``n`` samples of ``split`` that ``verify`` accepts (it adds ``ok``): attempts grow until there are enough, ``rounds`` times at most.

    Verified rows are written to the shared folder: programs may behave otherwise when they run again.
    """
    tries = max(16, int(n * over))
    for _ in range(rounds):
        rows = kept(verify(samples(spark, tries, base_seed)))
        if rows.where("ok").count() >= n:
            return first_accepted(rows, n, split)
        tries *= 2
    raise ValueError(f"fewer than {n} samples accepted in {tries // 2} attempts")


#: Splits and what each adds to the seed.
SPLITS = (("train", 0), ("val", 10_000), ("test_heldout", 20_000))


def verified_splits(spark: SparkSession, sizes: dict[str, int] | None = None, seed: int = 42, verify: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """All splits in one table with ``split``, each from its own seed; ``verify`` runs the programs unless another is given."""
    from .grading import verify_programs

    sizes = sizes or {"train": 1000, "val": 150, "test_heldout": 250}
    parts = [verified_dataset(spark, sizes[name], seed + more, name, verify or verify_programs, **options) for name, more in SPLITS if sizes.get(name)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
