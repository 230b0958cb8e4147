"""Ordered wildcard rules: the last rule that matches decides.

Rules and requests meet in an inverted index. A rule is listed under one gram of
``GRAM`` characters out of the longest literal run of its pattern, wherever in the
pattern that is: the gram that the fewest rules have. A request looks up the grams of
its text and is then tested on the whole patterns, so it only meets rules whose gram
it has. Rules without a literal (``*``, ``??``) fit by length alone; there are few
different ones, and they travel as one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import match_wildcard, wildcard_regex

#: Characters of an index entry; shorter runs are entries as they are.
GRAM = 3

# Fixed values.
DEFAULT_ACTION = "ask"
EDIT_TOOLS = ("edit", "write", "patch", "multiedit")

# How many words name a command, where it is more than one.
ARITY = {
    "aws": 3, "az": 3, "bazel": 2, "brew": 2, "bun": 2, "bun run": 3, "bun x": 3, "cargo": 2, "cargo add": 3,
    "cargo run": 3, "cdk": 2, "cf": 2, "cmake": 2, "composer": 2, "consul": 2, "consul kv": 3, "crictl": 2, "deno": 2,
    "deno task": 3, "doctl": 3, "docker": 2, "docker builder": 3, "docker compose": 3, "docker container": 3,
    "docker image": 3, "docker network": 3, "docker volume": 3, "eksctl": 2, "eksctl create": 3, "firebase": 2,
    "flyctl": 2, "gcloud": 3, "gh": 3, "git": 2, "git config": 3, "git remote": 3, "git stash": 3, "go": 2, "gradle": 2,
    "helm": 2, "heroku": 2, "hugo": 2, "ip": 2, "ip addr": 3, "ip link": 3, "ip netns": 3, "ip route": 3, "kind": 2,
    "kind create": 3, "kubectl": 2, "kubectl kustomize": 3, "kubectl rollout": 3, "kustomize": 2, "make": 2, "mc": 2,
    "mc admin": 3, "minikube": 2, "mongosh": 2, "mysql": 2, "mvn": 2, "ng": 2, "npm": 2, "npm exec": 3, "npm init": 3,
    "npm run": 3, "npm view": 3, "nvm": 2, "nx": 2, "openssl": 2, "openssl req": 3, "openssl x509": 3, "pip": 2,
    "pipenv": 2, "pnpm": 2, "pnpm dlx": 3, "pnpm exec": 3, "pnpm run": 3, "poetry": 2, "podman": 2,
    "podman container": 3, "podman image": 3, "psql": 2, "pulumi": 2, "pulumi stack": 3, "pyenv": 2, "python": 2,
    "rake": 2, "rbenv": 2, "redis-cli": 2, "rustup": 2, "serverless": 2, "sfdx": 3, "skaffold": 2, "sls": 2, "sst": 2,
    "swift": 2, "systemctl": 2, "terraform": 2, "terraform workspace": 3, "tmux": 2, "turbo": 2, "ufw": 2, "vault": 2,
    "vault auth": 3, "vault kv": 3, "vercel": 2, "volta": 2, "wp": 2, "yarn": 2, "yarn dlx": 3, "yarn run": 3,
}


def rules_from_config(configs: DataFrame) -> DataFrame:
    """Rules from (source, config) where config is ``{permission: action | {pattern: action}}``.

    Rows come back as (source, pos, permission, pattern, action); pos is a struct of
    the places of the permission and of the pattern in the text.
    """
    top = configs.select("source", F.posexplode(F.map_entries(F.from_json("config", "map<string,string>"))).alias("i", "e"))
    nested = F.startswith(F.ltrim(F.col("e.value")), F.lit("{"))
    entries = F.when(nested, F.map_entries(F.from_json("e.value", "map<string,string>"))).otherwise(
        F.array(F.struct(F.lit("*").alias("key"), F.col("e.value").alias("value")))
    )
    rows = top.select("source", "i", F.col("e.key").alias("permission"), F.posexplode(entries).alias("j", "r"))
    return rows.select("source", F.struct("i", "j").alias("pos"), "permission", F.col("r.key").alias("pattern"), F.col("r.value").alias("action"))


def merge_rulesets(*rulesets: DataFrame) -> DataFrame:
    """One list with ``idx``, the struct (ruleset, pos); rulesets are (pos, permission, pattern, action), all with pos of one type."""
    tagged = [
        r.select(F.struct(F.lit(i).alias("ruleset"), "pos").alias("idx"), "permission", "pattern", "action")
        for i, r in enumerate(rulesets)
    ]
    return reduce(DataFrame.unionByName, tagged)


def _grams(text: Column, size: int) -> Column:
    """The different pieces of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, pieces).otherwise(F.array().cast("array<string>"))


def _longest_run(pattern: Column) -> Column:
    """The longest stretch without wildcards that every match contains: a final `` *`` is optional as a whole."""
    core = F.when(F.endswith(pattern, F.lit(" *")), F.left(pattern, F.length(pattern) - 2)).otherwise(pattern)
    runs = F.transform(F.split(core, "[*?]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    return F.array_max(runs)["run"]


def _indexed(rules: DataFrame, matches: dict[str, str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rules by (side, gram), and those without any literal.

    ``side`` is the place in ``matches`` of the column whose gram it is: the last one that
    has a full gram, else the one with the longest run.
    """
    sides = list(matches.values())
    regexes = {f"_re{i}": wildcard_regex(F.col(r)) for i, r in enumerate(sides)}
    runs = rules.withColumns({**{f"_run{i}": _longest_run(F.col(r)) for i, r in enumerate(sides)}, **regexes})
    order = [F.struct(F.least(F.length(f"_run{i}"), F.lit(GRAM)).alias("n"), F.lit(i).alias("side"), F.col(f"_run{i}").alias("run")) for i in range(len(sides))]
    best = runs.withColumn("_best", F.array_max(F.array(*order))).select("_best.side", "_best.run", *regexes, *carried)
    grams = F.when(F.length("run") >= GRAM, _grams(F.col("run"), GRAM)).otherwise(F.array("run"))
    literal = best.where("run <> ''").select(F.struct(*regexes, *carried).alias("_rule"), "side", F.explode(grams).alias("gram"))
    counts = literal.groupBy("side", "gram").agg(F.count("*").alias("_n"))
    rarest = literal.join(counts, ["side", "gram"]).groupBy("_rule").agg(F.min(F.struct("_n", "gram", "side")).alias("_g"))
    return rarest.select("_g.side", "_g.gram", "_rule.*"), best.where("run = ''").select(*regexes, *carried)


def matching_rules(requests: DataFrame, rules: DataFrame, matches: dict[str, str], equal: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The distinct request columns with every rule that fits them, and the rules without any literal as one row.

    ``matches`` maps request columns to the rule columns with their patterns; of the other
    rule columns those in ``equal`` must also be equal. The second frame has ``_open``: an
    array of structs of the other columns and the regexes ``_re0``, ``_re1``, ...; with
    ``equal`` it has a row for each value of those.
    """
    columns = [*matches, *equal]
    carried = [c for c in rules.columns if c not in matches.values() or c in equal]
    indexed, pure = _indexed(rules.withColumnsRenamed({c: f"_eq_{c}" for c in equal}), matches, [f"_eq_{c}" if c in equal else c for c in carried])
    asked = requests.select(*columns).distinct()
    sided = lambda side: lambda g: F.struct(F.lit(side).alias("side"), g.alias("gram"))
    looked = [F.transform(F.concat(*[_grams(F.col(c), n) for n in range(1, GRAM + 1)]), sided(i)) for i, c in enumerate(matches)]
    fits = reduce(lambda a, b: a & b, [F.rlike(F.col(c), F.col(f"_re{i}")) for i, c in enumerate(matches)])
    fits = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_eq_{c}")) for c in equal], fits)
    grams = asked.withColumn("_gram", F.explode(F.concat(*looked))).select(*columns, "_gram.side", "_gram.gram", *[F.col(c).alias(f"_eq_{c}") for c in equal])
    # Exploded rows are more than Spark takes them for: no broadcast by their estimate.
    on = ["side", "gram", *[f"_eq_{c}" for c in equal]]
    hits = grams.hint("merge").join(indexed, on).where(fits)
    rest = [c for c in carried if c not in equal]
    scopes = [F.col(f"_eq_{c}").alias(c) for c in equal]
    open_rules = pure.groupBy(*scopes).agg(F.collect_list(F.struct(*[c for c in pure.columns if not c.startswith("_eq_")])).alias("_open"))
    return hits.select(*columns, *rest), open_rules


def last_match(requests: DataFrame, rules: DataFrame, matches: dict[str, str], result: str) -> DataFrame:
    """Add ``result`` (and ``<result>_pattern``) of the last rule, by ``idx``, that matches all of ``matches``.

    ``matches`` maps request columns to rule columns; the last one should be the most
    telling, as the index prefers it.
    """
    columns = list(matches)
    # Of rules with the same patterns only the last can win.
    same = sorted({*matches.values(), "pattern"})
    newest = F.max_by(F.struct("idx", result), "idx").alias("_r")
    kept = rules.groupBy(*same).agg(newest).select(*same, F.col("pattern").alias(f"{result}_pattern"), "_r.*")
    hits, open_rules = matching_rules(requests, kept.drop(*[c for c in same if c not in matches.values()]), matches)
    verdict = F.struct("idx", result, f"{result}_pattern")
    verdicts = hits.groupBy(*columns).agg(F.max_by(verdict, "idx").alias("_v"))
    found = requests.join(verdicts, columns, "left").select(*requests.columns, "_v")  # null columns fit no rule
    found = found.join(F.broadcast(open_rules))  # one row
    fits = lambda r: reduce(lambda a, b: a & b, [F.rlike(F.col(c), r[f"_re{i}"]) for i, c in enumerate(columns)])
    fitting = F.transform(F.filter("_open", fits), lambda r: F.struct(r["idx"].alias("idx"), r[result].alias(result), r[f"{result}_pattern"].alias(f"{result}_pattern")))
    last = F.aggregate(fitting, F.col("_v"), lambda best, r: F.when(best.isNull() | (best["idx"] < r["idx"]), r).otherwise(best))
    found = found.withColumn("_v", last)
    return found.select(*requests.columns, F.col(f"_v.{result}"), F.col(f"_v.{result}_pattern"))


def evaluate_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Action for each (permission, pattern)."""
    matches = {"permission": "permission", "pattern": "pattern"}
    found = last_match(requests, rules, matches, "action")
    return found.withColumn("action", F.coalesce("action", F.lit(DEFAULT_ACTION))).drop("action_pattern")


def evaluate_requests(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Action for each (id, permission, patterns): the first that is not allow, else allow."""
    rows = requests.select("id", "permission", F.posexplode("patterns").alias("pos", "pattern"))
    verdicts = evaluate_rules(rows, rules).where(F.col("action") != "allow")
    first = verdicts.groupBy("id").agg(F.min_by("action", "pos").alias("action"))
    return requests.select("id").join(first, "id", "left").withColumn("action", F.coalesce("action", F.lit("allow")))


def disabled_tools(tools: DataFrame, rules: DataFrame) -> DataFrame:
    """Tools whose last rule by name denies everything."""
    named = tools.withColumn("permission", F.when(F.col("tool").isin(*EDIT_TOOLS), "edit").otherwise(F.col("tool")))
    found = last_match(named, rules, {"permission": "permission"}, "action")
    return found.where((F.col("action") == "deny") & (F.col("action_pattern") == "*")).select("tool")


def specific_pattern(inputs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Value of the longest pattern (then the greatest) matching ``text``; patterns are (pattern, value)."""
    ranked = patterns.withColumn("idx", F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("p")))
    return last_match(inputs, ranked, {"text": "pattern"}, "value").drop("value_pattern")


def command_prefix(tokens: Column) -> Column:
    """The words that name a command, by the longest known prefix; one word otherwise."""
    table = F.create_map(*[F.lit(x) for prefix, n in ARITY.items() for x in (prefix, n)])
    words = max(len(p.split()) for p in ARITY)
    known = [F.try_element_at(table, F.array_join(F.slice(tokens, 1, n), " ")) for n in range(words, 0, -1)]
    return F.slice(tokens, F.lit(1), F.coalesce(*known, F.lit(1)))


def match_rules(texts: DataFrame) -> DataFrame:
    """(text, pattern) rows with ``matched``."""
    return texts.withColumn("matched", match_wildcard(F.col("text"), F.col("pattern")))
