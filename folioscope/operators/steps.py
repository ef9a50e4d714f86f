"""Procedures: checks of their steps, and runs of their steps over tables of parameters.

A procedure runs for many sets of parameters at once: the blackboard is a row, its values are columns, and
each step adds the columns of its outputs. Steps run in the order of their list.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graph import cycles_and_gaps
from folioscope.operators.lookup import compiled

#: A tool takes the columns of its inputs by name and gives the columns of its results by name.
Tool = Callable[[Mapping[str, Column]], Mapping[str, Column]]
# Texts that stand for no value, results that describe a run and aren't values, other names of outputs.
NO_VALUE = ("error", "failed", "null", "none", "undefined", "nan", "")
NO_RESULT = frozenset({"result", "results", "labeled_results", "errors", "error", "expression", "cleaned_expression", "variables_used", "solve_for", "unknowns"})
ALIASES = {
    "dwl_basic": ("design_high_water_level", "basic", "design"), "dwl_extreme": ("extreme_high_water_level", "extreme"),
    "delta_w_basic": ("delta_w_10yr", "10yr", "10_year", "10年", "basic"), "delta_w_extreme": ("delta_w_2yr", "2yr", "2_year", "2年", "extreme"),
    "e_basic": ("e_basic", "basic", "10yr", "10年"), "e_extreme": ("e_extreme", "extreme", "2yr", "2年"), "t": ("满载吃水t", "吃水t", "design_draft", "draft", "吃水"),
    "z1": ("z1", "龙骨下最小富裕深度"), "z2": ("z2", "波浪富裕深度"), "z3": ("z3", "船舶装载纵倾富裕深度", "船尾吃水"), "z4": ("z4", "备淤富裕深度"),
}


@dataclass(frozen=True)
class Step:
    """A step: its tool, inputs (name -> `${column}` or a constant) and outputs (column -> `.`, `result`, a result's name or a constant)."""

    name: str
    tool: str
    inputs: Mapping[str, object] = field(default_factory=dict)
    outputs: Mapping[str, str] | str = field(default_factory=dict)


class Registry:
    """Tools by name; a name that is given twice is an error. A tool takes the columns of a step's inputs, or with `of_step` the step and the rows."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}
        self._of_step: set[str] = set()

    def add(self, name: str, *, of_step: bool = False) -> Callable[[Tool], Tool]:
        def keep(tool: Tool) -> Tool:
            if name in self._tools:
                raise ValueError(f"a tool has the name already: {name}")
            self._tools[name] = tool
            if of_step:
                self._of_step.add(name)
            return tool

        return keep

    def call(self, step: Step, rows: DataFrame) -> Mapping[str, Column]:
        """The results of a step's tool as columns by name; what isn't registered here may be a standard tool."""
        own = self if step.tool in self else TOOLS
        tool = own[step.tool]
        if step.tool in own._of_step:
            return tool(step, rows)
        return tool({k: F.col(str(v)[2:-1]) if str(v).startswith("${") else F.lit(v) for k, v in step.inputs.items()})

    def __getitem__(self, name: str) -> Tool:
        if name not in self._tools:
            raise KeyError(f"unknown tool: {name}")
        return self._tools[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tools

    def names(self) -> list[str]:
        return sorted(self._tools)


def is_value(value: Column, kind: str) -> Column:
    """Whether a column holds something that counts as present."""
    if kind == "string":
        return F.coalesce(~F.lower(F.trim(value)).isin(*NO_VALUE), F.lit(False))
    if kind in ("double", "float"):
        return value.isNotNull() & ~F.isnan(value)
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def constant(text: str) -> object:
    """A constant written as text: true, false, a whole or another number; None for anything else."""
    plain = text.strip().lower()
    if plain in ("true", "false"):
        return plain == "true"
    try:
        return int(plain) if plain.lstrip("+-").isdigit() else float(plain)
    except ValueError:
        return None


def selected(output: str, results: Mapping[str, Column], kinds: Mapping[str, str]) -> Column | None:
    """Which of several results an output means: that of its name, for `e` the largest number, one whose name has an alias of
    it, or the only one there is."""
    values = {k: v for k, v in results.items() if k not in NO_RESULT}
    if output in values:
        return values[output]
    numbers = [v for k, v in values.items() if kinds.get(k, "double") in ("double", "float", "int", "bigint", "long")]
    if output.lower() == "e" and numbers:
        return F.greatest(*numbers) if len(numbers) > 1 else numbers[0]
    for alias in ALIASES.get(output.lower(), ()):
        for name, value in values.items():
            if alias in name.lower():
                return value
    return next(iter(values.values())) if len(values) == 1 else None


def calculator(step: Step, rows: DataFrame) -> Mapping[str, Column]:
    """The value of the step's `expression` over its other inputs, compiled into a column."""
    inputs = {k: v for k, v in step.inputs.items() if k != "expression"}
    if missing := [str(v)[2:-1] for v in inputs.values() if str(v).startswith("${") and str(v)[2:-1] not in rows.columns]:
        raise KeyError(f"no value of {', '.join(missing)}")
    value = lambda name: F.col(str(inputs[name])[2:-1]).cast("double") if str(inputs[name]).startswith("${") else F.lit(float(inputs[name]))
    return {"result": compiled(str(step.inputs["expression"]), list(inputs), value)}


#: The standard tools.
TOOLS = Registry()
TOOLS.add("calculator", of_step=True)(calculator)


def run_step(rows: DataFrame, step: Step, tools: Registry = TOOLS) -> DataFrame:
    """Rows with the outputs of one step; rows that hold all of them already keep theirs, and a step that fails leaves null.

    An error of one step doesn't end the others: it is added to the array column `problems` as `name: what`.
    """
    problems = F.col("problems") if "problems" in rows.columns else F.array().cast("array<string>")
    try:
        results = tools.call(step, rows)
        wanted = {k: k for k in results} if step.outputs == "*" else dict(step.outputs)
        added = {}
        for name, source in wanted.items():
            if source in ("", ".", "result"):
                value = results.get("result", results.get(name, selected(name, results, {})))
            elif source in results:
                value = results[source]
            else:
                value = F.lit(constant(source)) if constant(source) is not None else selected(name, results, {})
            if value is not None:
                added[name] = value
        rows.select(*(v.alias(k) for k, v in added.items())).schema  # noqa: B018  (analyses the columns, so that a bad step fails here)
    except Exception as error:  # noqa: BLE001  (whatever a tool raises is a problem of its step)
        told = F.lit(f"{step.name}: {str(error).strip().splitlines()[0][:120]}")
        return rows.withColumn("problems", F.array_append(problems, told))
    kinds = dict(rows.dtypes)
    there = [is_value(F.col(k), kinds[k]) if k in kinds else F.lit(False) for k in (added if step.outputs != "*" else ())]
    done = F.lit(bool(there))
    for one in there:
        done = done & one
    kept = {k: F.when(done, F.col(k)).otherwise(v) if k in kinds else v for k, v in added.items()}
    return rows.withColumns(kept | {"problems": problems})


def run(rows: DataFrame, steps: Sequence[Step], tools: Registry = TOOLS) -> DataFrame:
    """Rows of parameters with the outputs of all steps, in the order of the list, and the problems that came up."""
    for step in steps:
        rows = run_step(rows, step, tools)
    return rows


def step_problems(steps: DataFrame, known_tools: Sequence[str]) -> DataFrame:
    """(sop_id, step_id, problem) of the steps of procedures (sop_id, place, step_id, tool, analysed, next_step_id, description).

    Repeated ids, unknown tools, analysed steps whose tool is still open, empty descriptions, successors that don't
    exist, and members of rings.
    """
    tool = F.lower(F.trim(F.coalesce("tool", F.lit(""))))
    counted = steps.withColumn("_times", F.count("*").over(Window.partitionBy("sop_id", "step_id")))
    found = F.array(
        F.when(F.col("_times") > 1, "repeated id"),
        F.when((tool == "auto") & F.col("analysed"), "analysed without a tool").when(~tool.isin("auto", "", *known_tools), "unknown tool"),
        F.when(F.trim(F.coalesce("description", F.lit(""))) == "", "no description"),
    )
    own = counted.select("sop_id", "step_id", F.explode(F.array_compact(found)).alias("problem")).distinct()
    name = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct("sop_id", F.col(c).alias("id"))))
    graph = cycles_and_gaps(steps.select(name("step_id").alias("step_id"), name("next_step_id").alias("next_id")).distinct())
    ids = steps.select(name("step_id").alias("name"), "sop_id", "step_id").distinct()
    return own.unionByName(graph.withColumnRenamed("step_id", "name").join(ids, "name").select("sop_id", "step_id", "problem"))


def missing_inputs(steps: DataFrame, required: DataFrame) -> DataFrame:
    """(sop_id, key): required values (sop_id, key) that neither the question nor any step's outputs or references provide.

    steps: sop_id, inputs (map of texts), outputs (map).
    """
    named = F.flatten(F.transform(F.map_values("inputs"), lambda v: F.regexp_extract_all(v, F.lit(r"\$\{([^}.]+)[^}]*\}"), F.lit(1))))
    given = steps.select("sop_id", F.explode(F.array_union(F.map_keys("outputs"), named)).alias("key")).distinct()
    return required.where("key <> 'user_query'").join(given, ["sop_id", "key"], "left_anti")


def step_template(nodes: DataFrame) -> DataFrame:
    """(path_id, place, names, layer): the nodes of paths (path_id, place, name, layer) as steps: neighbouring concepts are one step."""
    order = Window.partitionBy("path_id").orderBy("place")
    begins = (F.col("layer") != "concept") | (F.coalesce(F.lag("layer").over(order), F.lit("")) != "concept")
    rows = nodes.withColumn("step", F.sum(begins.cast("int")).over(order))
    names = F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return rows.groupBy("path_id", "step").agg(names.alias("names"), F.first("layer").alias("layer")).select("path_id", F.col("step").cast("long").alias("place"), "names", "layer")
