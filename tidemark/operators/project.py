"""Project statistics: downloads, commits, benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import neighbours, ordinal
from tidemark.session import checkpointed

# Fixed values.
NOISE = r"(?i)\A(ignore:|test:|chore:|ci:|release:)"
BENCHMARK_RUNS = 100
RESULT = (
    "averageScore double, tasks array<struct<averageScore: double, task: struct<id: string>,"
    " runs: array<struct<model: string, agent: string, score: struct<final: double, base: double, penalty: double>,"
    " scoreDetails: array<struct<criterion: string, weight: double, average: double>>>>>>"
)


# -- downloads -----------------------------------------------------------------------


def download_totals(assets: DataFrame) -> DataFrame:
    """Downloads per release, and over all as the row without a tag."""
    return assets.rollup("tag").agg(F.sum("downloads").alias("downloads"))


def package_downloads(days: DataFrame) -> DataFrame:
    return days.groupBy("package").agg(F.sum("downloads").alias("downloads"))


def download_deltas(series: DataFrame, columns: tuple[str, ...] = ("first", "second", "total")) -> DataFrame:
    """Change of each column from the previous row, 0 in the first; rows are ordered by (date, row)."""
    both = neighbours(series.withColumn("_all", F.lit(1)), ["_all"], ["date", "row"], F.struct(*columns))
    deltas = [(F.col(c) - F.coalesce(F.col("previous")[c], F.col(c))).alias(f"{c}_delta") for c in columns]
    return both.select(*series.columns, *deltas)


# -- commits ---------------------------------------------------------------------------


def commits_in_range(hashes: DataFrame, commits: DataFrame) -> DataFrame:
    """Metadata of the listed hashes, with the first line of the message as title."""
    titled = commits.withColumn("title", F.substring_index("message", "\n", 1))
    return titled.join(hashes.select("hash").distinct(), "hash", "left_semi")


def areas_of(files: Column, areas: tuple[tuple[str, str], ...]) -> Column:
    """Sorted areas that the files belong to; of the (prefix, area) pairs the first that fits decides."""

    def area(path: Column) -> Column:
        found = F.when(F.startswith(path, F.lit(areas[0][0])), areas[0][1])
        for prefix, name in areas[1:]:
            found = found.when(F.startswith(path, F.lit(prefix)), name)
        return found

    return F.array_sort(F.array_distinct(F.filter(F.transform(files, area), lambda a: a.isNotNull())))


def filter_commits(commits: DataFrame, areas: tuple[tuple[str, str], ...]) -> DataFrame:
    """Commits with a telling title that touch a known area."""
    titled = commits.withColumns({"title": F.substring_index("message", "\n", 1), "areas": areas_of(F.col("files"), areas)})
    return titled.where(~F.rlike("title", F.lit(NOISE)) & (F.size("areas") > 0)).select(
        F.left("hash", F.lit(7)).alias("hash"), "seq", "author", "title", "areas"
    )


def cancel_reverts(commits: DataFrame, size: int = 256) -> DataFrame:
    """Commits left after each ``Revert "…"`` has cancelled what it names, or the other way round.

    Commits are grouped by the title inside all the wrappers. A title without wrappers
    keeps its last commit. Of the others, ``size`` commits in a row become one effect: for
    every set of wrapping depths that may be open before them, which commits are open
    afterwards. Effects compose, so ``size`` of them in a row become one, and so on until
    a title has a single one: no task sees a longer list, however often a title returns.
    A title that occurs in k depths has effects for 2^k sets; k is 2 or 3 in practice.
    """
    wrappers = F.length(F.regexp_extract("title", r'\A((?:Revert ")*)', 1)) / 8
    quotes = F.length(F.regexp_extract("title", r'("*)\z', 1))
    depth = F.least(wrappers, quotes).cast("int")
    base = F.substring(F.col("title"), 8 * F.col("depth") + 1, F.length("title") - 9 * F.col("depth"))
    rows = commits.withColumn("depth", depth).withColumn("base", base).select("base", "seq", "depth")
    per_base = rows.groupBy("base").agg(F.max("depth").alias("deepest"), F.max("seq").alias("seq"), F.sort_array(F.collect_set("depth")).alias("depths"))
    plain = per_base.where("deepest = 0").select("seq")
    wrapped = rows.join(per_base.where("deepest > 0").select("base", "depths"), "base")

    def step(open_: Column, commit: Column) -> Column:
        other = F.when(commit["depth"] > 0, commit["depth"] - 1).otherwise(1)
        without = lambda d: F.filter(open_, lambda s: s["depth"] != d)
        added = F.concat(without(commit["depth"]), F.array(F.struct(commit["depth"].alias("depth"), commit["seq"].cast("long").alias("seq"))))
        return F.when(F.exists(open_, lambda s: s["depth"] == other), without(other)).otherwise(added)

    # A commit that is open from before has no seq here.
    before = lambda chosen: F.transform(
        F.filter("depths", lambda d, i: F.call_function("shiftright", chosen, i).bitwiseAND(1) == 1),
        lambda d: F.struct(d.alias("depth"), F.lit(None).cast("long").alias("seq")),
    )
    subsets = F.sequence(F.lit(0), F.pow(F.lit(2), F.size("depths")).cast("int") - 1)
    effect = F.transform(subsets, lambda chosen: F.aggregate("commits", before(chosen), step))
    numbered = ordinal(wrapped, ["base"], ["seq"]).withColumn("block", F.floor((F.col("position") - 1) / size))
    lists = numbered.groupBy("base", "depths", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "depth"))).alias("commits"))
    effects = checkpointed(lists.select("base", "depths", "block", effect.alias("effect")))

    def then(first: Column, second: Column) -> Column:
        chosen = lambda open_: F.aggregate(
            open_, F.lit(0), lambda m, s: m + F.call_function("shiftleft", F.lit(1), (F.array_position(F.col("depths"), s["depth"]) - 1).cast("int"))
        )
        seq_of = lambda open_, s: F.coalesce(s["seq"], F.get(F.filter(open_, lambda o: o["depth"] == s["depth"]), F.lit(0))["seq"])
        named = lambda open_: F.transform(F.get(second["effect"], chosen(open_)), lambda s: F.struct(s["depth"].alias("depth"), seq_of(open_, s).alias("seq")))
        return F.transform(first, named)

    while not effects.where("block > 0").isEmpty():
        rows = F.sort_array(F.collect_list(F.struct("block", "effect")))
        together = effects.groupBy("base", "depths", F.floor(F.col("block") / size).alias("next")).agg(rows.alias("rows"))
        composed = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.col("rows")[0]["effect"], then)
        effects = checkpointed(together.select("base", "depths", F.col("next").alias("block"), composed.alias("effect")))
    survivors = effects.select(F.explode(F.col("effect")[0]["seq"]).alias("seq"))
    return commits.join(survivors.unionByName(plain), "seq", "left_semi")


def changelog_sections(
    commits: DataFrame, sections: tuple[tuple[str, str], ...], team: tuple[str, ...] = (), rest: str = "Other"
) -> DataFrame:
    """Changelog lines in order: (section, seq, line), a heading (seq null) before its entries.

    Of the (area, section) pairs the first whose area a commit has gives its section,
    ``rest`` if none does; sections come in the order of the pairs, ``rest`` last.
    """
    fitting = [F.when(F.array_contains("areas", area), section) for area, section in sections]
    names = list(dict.fromkeys([section for _, section in sections] + [rest]))
    outside = F.col("author").isNotNull() & ~F.col("author").isin(*team)
    credit = F.when(outside, F.concat(F.lit(" (@"), "author", F.lit(")"))).otherwise("")
    entries = commits.select(
        F.coalesce(*fitting, F.lit(rest)).alias("section"), "seq", F.concat(F.lit("- "), "title", credit).alias("line")
    )
    headings = entries.select("section").distinct().select(
        "section", F.lit(None).cast("long").alias("seq"), F.concat(F.lit("## "), "section").alias("line")
    )
    order = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("section"))
    return headings.unionByName(entries).orderBy(order, F.asc_nulls_first("seq"))


def contributors(commits: DataFrame, team: DataFrame) -> DataFrame:
    """Distinct (author, title) of everybody outside the team."""
    titled = commits.select("author", F.substring_index("message", "\n", 1).alias("title"))
    return (
        titled.where(F.col("author").isNotNull() & ~F.rlike("title", F.lit(NOISE)))
        .join(team.select("author"), "author", "left_anti")
        .distinct()
    )


# -- benchmark -------------------------------------------------------------------------


def benchmark_matrix(runs: DataFrame, tasks: list[str] | None = None, n: int = BENCHMARK_RUNS) -> DataFrame:
    """The ``n`` newest runs, one score column per task: of a repeated task the last score, of a run without tasks none.

    Name the ``tasks``: else Spark runs a job of its own to find them.
    """
    newest = runs.orderBy(F.desc("created"), F.desc("id")).limit(n)
    parsed = newest.select("id", "agent", "model", F.from_json("result", RESULT).alias("r"))
    scores = parsed.select("id", "agent", "model", F.col("r.averageScore").alias("average"), F.posexplode_outer("r.tasks").alias("at", "t"))
    return scores.groupBy("id", "agent", "model", "average").pivot("t.task.id", tasks).agg(F.max_by("t.averageScore", "at"))


def benchmark_task(runs: DataFrame, run_id: int | str, task: str) -> DataFrame:
    """Every scored criterion of one task of one run."""
    found = (
        runs.where(F.col("id") == run_id)
        .select("id", F.from_json("result", RESULT).alias("r"))
        .select("id", F.get(F.filter("r.tasks", lambda t: t["task"]["id"] == task), F.lit(0)).alias("t"))
    )
    return (
        found.select("id", F.col("t.averageScore").alias("average_score"), F.posexplode("t.runs").alias("run", "x"))
        .select("id", "average_score", "run", F.col("x.score.final").alias("final"), F.inline("x.scoreDetails"))
    )
