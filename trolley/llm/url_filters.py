"""Judge URLs by rules, and by a tree of path templates where no rule fits.

The tree of each host goes as deep as some node has ``min_pages`` pages with a further segment. A
segment that too few pages share becomes a wildcard, so ``/user/17/posts`` and ``/user/18/posts``
meet in ``/user/*/posts``. Then, from the top, a literal branch whose share of bad labelled pages
does not differ from its parent's by more than ``similar`` standard errors is merged into the
wildcard branch beside it. A template is blocked if its smoothed share of bad pages, shrunk
towards its host and the host towards all pages, reaches ``block_from``.

Neither goes level by level. As long as the pages of a node stay together, because all have the
same segment or none has enough pages, how often each segment stands at each level says where they
first part, and all levels before that are taken in one step. So the number of steps is that of
the forks on a path, not of its segments. Paths that are at their end leave the loop. What a step
says about nodes is written before paths are joined to it, so that the join can be split where a
host or template has very many of them; pages meet their verdict in one join at the end.

Defined results: a url that is null or lacks ``://`` has an empty host and path; such rows form
one host of their own. Empty segments do not count. Segments below the deepest level, where no node has enough pages
to tell any of them apart, do not count either.
Pages without a label count for support only, and without any label every template is allowed.
A page with several labels is bad if one of them is. Repeated rows each get their verdict; an
empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.stages import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A template has so many levels at least, empty below the end of the path.
LEVELS = 3
MIN_PAGES = 20
SIMILAR = 2.58
WEIGHT = 10.0
BLOCK_FROM = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://``, cut at ``/``, and at ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits.

    ``rules`` maps a host with a path, such as ``example.net/en/``, to ``block`` or ``allow``.
    They become part of the expression: a list for a team to keep by hand, not a table.
    """
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: dict[str, str],
    min_pages: int = MIN_PAGES,
    similar: float = SIMILAR,
    weight: float = WEIGHT,
    block_from: float = BLOCK_FROM,
) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, template and badness.

    ``labels`` has ``page_id`` and a boolean ``bad``. A branch stays literal if at least
    ``min_pages`` pages have it, however many its parent has. ``weight`` is how many labelled
    pages the opinion of the next level up is worth.
    """
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    host, path = url_parts(pages["url"])
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = staged(
        parsed.join(known, "page_id", "left").withColumn(
            "segments", F.filter(F.split("path", "/"), lambda s: s != "")
        ),
        "rows",
    )
    paths = staged(
        rows.groupBy("host", "segments").agg(
            F.count("*").alias("pages"),
            F.count("bad").alias("labelled"),
            F.count_if("bad").alias("bad"),
        ),
        "paths",
    )
    named = _named(paths, min_pages)
    tree = staged(
        named.groupBy("host", "names").agg(
            F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
        ),
        "tree",
    )
    everywhere = tree.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("n")).first()
    overall = everywhere["bad"] / everywhere["n"] if everywhere["n"] else 0.0
    merged = _merged(tree, overall, similar, weight)
    of_host = tree.groupBy("host").agg(_smoothed(overall, weight).alias("host_badness"))
    scored = (
        merged.groupBy("host", "merged")
        .agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
        .join(of_host, "host")
        .withColumn(
            "badness",
            (F.col("bad") + weight * F.col("host_badness")) / (F.col("labelled") + weight),
        )
        .drop("bad", "labelled")
    )
    levels = F.concat(
        "merged", F.array_repeat(F.lit(""), F.greatest(F.lit(0), LEVELS - F.size("merged")))
    )
    verdicts = merged.select("host", "names", "merged").join(scored, ["host", "merged"]).select(
        "host", "names", F.concat_ws("/", F.col("host"), levels).alias("template"), "badness"
    )
    by_path = staged(
        named.select("host", "segments", "names").join(verdicts, ["host", "names"]).drop("names"),
        "verdicts",
    )
    rule, by_rule = longest_rule(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("badness") >= block_from, "block").otherwise("allow")
    return rows.join(by_path, ["host", "segments"]).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(by_rule, by_tree).alias("verdict"),
        "template",
        F.round("badness", 9).alias("badness"),
    )


def _named(paths: DataFrame, min_pages: int) -> DataFrame:
    """``paths`` with the names of their levels: segments, or wildcards for rare ones."""
    no_names = F.array().cast("array<string>")
    live = paths.select("host", "segments", "pages", no_names.alias("names"))
    done, depth = [live.where(F.size("segments") == 0).drop("pages")], LEVELS
    live = live.where(F.size("segments") > 0)
    node = ["host", "names"]
    while not live.isEmpty():
        # How many pages of a node have each segment at each of the levels below it.
        level = F.posexplode(F.slice("segments", F.size("names") + 1, F.size("segments")))
        counts = staged(
            live.select(*node, "pages", level.alias("at", "segment"))
            .groupBy(*node, "at", "segment")
            .agg(F.sum("pages").alias("n")),
            "counts",
        )
        few = F.col("total") < min_pages
        together = (F.col("most") == F.col("total")) | (F.col("most") < min_pages)
        forks = staged(
            counts.groupBy(*node, "at")
            .agg(
                F.sum("n").alias("total"),
                F.max("n").alias("most"),
                F.max_by("segment", "n").alias("segment"),
            )
            .select(
                *node,
                "at",
                F.when(few, "end").when(together, "on").otherwise("fork").alias("kind"),
                F.when(F.col("most") < min_pages, "*").otherwise(F.col("segment")).alias("name"),
            )
            .groupBy(*node)
            .agg(
                F.min(F.when(F.col("kind") != "on", F.struct("at", "kind"))).alias("stop"),
                F.array_sort(F.collect_list(F.struct("at", "name"))).alias("run"),
            )
            .select(
                *node,
                F.coalesce("stop.at", F.size("run")).alias("stop"),
                F.coalesce(F.col("stop.kind") == "fork", F.lit(False)).alias("fork"),
                F.transform("run", lambda r: r["name"]).alias("run"),
            )
            .withColumn("run", F.slice("run", F.lit(1), F.col("stop"))),
            "forks",
        )
        reached = forks.agg(F.max(F.size("names") + F.col("stop") + F.col("fork").cast("int"))).first()[0]
        depth = max(depth, reached or 0)
        literal = staged(
            counts.where(F.col("n") >= min_pages)
            .join(forks.where("fork").select(*node, F.col("stop").alias("at")), [*node, "at"])
            .select(*node, "segment", F.lit(True).alias("literal")),
            "literal",
        )
        left = F.size("segments") - F.size("names")
        moved = (
            live.join(forks, node)
            .withColumn("segment", F.when(F.col("fork"), F.get("segments", F.size("names") + F.col("stop"))))
            .join(literal, [*node, "segment"], "left")
        )
        name = F.when(F.col("literal"), F.col("segment")).otherwise("*")
        grown = F.concat("names", F.slice("run", F.lit(1), left))
        live = staged(
            moved.select(
                "host",
                "segments",
                "pages",
                F.when(F.col("segment").isNull(), grown)
                .otherwise(F.concat(grown, F.array(name)))
                .alias("names"),
                (F.col("fork") & (left > F.col("stop") + 1)).alias("on"),
            ),
            "named",
        )
        done.append(live.where("not on").drop("pages", "on"))
        live = live.where("on").drop("on")
    names = reduce(DataFrame.unionByName, done)
    rest = F.least(F.size("segments"), F.lit(depth)) - F.size("names")
    stars = F.array_repeat(F.lit("*"), F.greatest(F.lit(0), rest))
    return staged(
        paths.join(names.withColumn("names", F.concat("names", stars)), ["host", "segments"]),
        "names",
    )


def _merged(tree: DataFrame, overall: float, similar: float, weight: float) -> DataFrame:
    """``tree`` with the names of merged branches, from the top, as ``merged``."""
    live = tree.withColumn("merged", F.array().cast("array<string>"))
    done, node, p = [], ["host", "merged"], F.col("p")

    def differs(bad: Column, n: Column) -> Column:
        apart = F.abs(bad / n - p) > similar * F.sqrt(p * (1 - p) / n)
        return F.coalesce((n > 0) & apart, F.lit(False))

    while not live.isEmpty():
        rest = F.slice("names", F.size("merged") + 1, F.greatest(F.size("names"), F.lit(1)))
        live = live.withColumn("rest", rest)
        same = F.zip_with("first", "last", lambda a, b: F.coalesce(a == b, F.lit(False)))
        alike = F.array_position(same, False)
        nodes = staged(
            live.groupBy(*node)
            .agg(
                F.sum("bad").alias("all_bad"),
                F.sum("labelled").alias("all_n"),
                F.min("rest").alias("first"),
                F.max("rest").alias("last"),
                _smoothed(overall, weight).alias("p"),
            )
            .withColumn("alike", F.when(alike == 0, F.size(same)).otherwise(alike - 1))
            .withColumn("all_apart", differs(F.col("all_bad"), F.col("all_n")))
            .select(*node, "p", "alike", "all_apart"),
            "nodes",
        )
        branch = F.coalesce(F.get("rest", F.lit(0)), F.lit(""))
        joined = live.join(nodes, node).withColumn("branch", branch)
        apart = staged(
            joined.where((F.col("alike") == 0) & (F.col("branch") != ""))
            .groupBy(*node, "branch")
            .agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("n"), F.any_value("p").alias("p"))
            .where(differs(F.col("bad"), F.col("n")))
            .select(*node, "branch", F.lit(True).alias("apart")),
            "apart",
        )
        run = F.slice("rest", F.lit(1), F.col("alike").cast("int"))
        taken = F.when(
            F.col("alike") > 0,
            F.when(F.col("all_apart"), run).otherwise(F.transform(run, lambda _: F.lit("*"))),
        ).otherwise(F.array(F.when(F.col("apart"), F.col("branch")).otherwise("*")))
        columns = [*tree.columns, "merged"]
        done.append(joined.where("branch = ''").select(*columns))
        live = staged(
            joined.where("branch <> ''")
            .join(apart, [*node, "branch"], "left")
            .withColumn("merged", F.concat("merged", taken))
            .select(*columns),
            "merged",
        )
    return staged(reduce(DataFrame.unionByName, done), "done") if done else live


def _smoothed(towards: float, weight: float) -> Column:
    return (F.sum("bad") + weight * F.lit(towards)) / (F.sum("labelled") + weight)

