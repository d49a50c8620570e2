"""URL block and allow rules that reach the aliases of a page.

Redirects and canonical links are edges between addresses. Connected components over all
edges form classes of aliases; a class takes the decision of a rule that fits any of its
addresses, and an explicit allow goes before a block. A page's own rule goes before its class.
Only built-in DataFrame functions are used.

Null or malformed addresses have an empty host and path and no aliases; null html has no
links. Rows with one ``page_id`` are judged one by one. Empty tables give no rows; extra
columns pass through, and columns the operator adds replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.components import connected_components
from gridpanel.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct ``(rule, verdict)``, or null; of equally long ones an allow.

    ``rules`` is a list the caller writes down, so it travels inside the plan.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The node of an address: host, path and query, without scheme and fragment; null without host."""
    host = host_of(url)
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def links(url: Column, html: Column) -> Column:
    """Absolute targets of the page's canonical link and of its instant redirect."""
    page = F.coalesce(html, F.lit(""))
    href = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    canonical = F.regexp_extract(F.regexp_extract(page, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>""", 0), href, 1)
    moved = F.regexp_extract(page, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>""", 0)
    moved = F.regexp_extract(moved, r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?\s*([^"'>\s]+)""", 1)
    lower = F.lower(page)
    canonical = F.when(lower.contains("canonical"), canonical).otherwise(F.lit(""))
    moved = F.when(lower.contains("refresh"), moved).otherwise(F.lit(""))
    host = host_of(url)

    def absolute(to: Column) -> Column:
        to = F.replace(to, F.lit("&amp;"), F.lit("&"))
        folder = F.regexp_extract(path_of(url), r"^(.*/)?", 0)
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        return (
            F.when(to.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), to)
            .when(to.startswith("//"), F.concat(F.lit("http:"), to))
            .when(to.startswith("/"), F.concat(F.lit("http://"), host, to))
            .when(to.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(F.lit("http://"), host, folder, to))
        )

    return F.array_compact(F.array(F.when(canonical != "", absolute(canonical)), F.when(moved != "", absolute(moved))))


def judge(
    pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, default: str = "allow", url: str = "url", html: str = "html"
) -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``pages``.

    ``redirects`` may name further edges ``(from_url, to_url)``. Only linked addresses enter
    the components, so pages without links cost one scan.
    """
    edges = pages.where(F.col(url).isNotNull()).select(
        address(F.col(url)).alias("a"), F.explode(F.transform(links(F.col(url), F.col(html)), address)).alias("b")
    )
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")))
    edges = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    own = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("_own", own)
    judged = judged.withColumn("rule", F.col("_own.rule"))
    if edges.isEmpty():
        return judged.withColumn("verdict", F.coalesce("_own.verdict", F.lit(default))).drop("_own")
    classes = connected_components(edges)
    node_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = classes.withColumn("_v", rule_for(host_of(node_url), path_of(node_url), rules)["verdict"])
    # "allow" sorts before "block": the smallest decision of a class is an allow if there is one
    decided = materialize(ruled.groupBy("component").agg(F.min("_v").alias("_class")).where("_class IS NOT NULL"))
    aliases = classes.join(decided, "component").select(F.col("node").alias("_node"), "_class")
    judged = judged.withColumn("_node", address(F.col(url)))
    judged = judged.join(aliases, "_node", "left")
    return judged.withColumn("verdict", F.coalesce("_own.verdict", "_class", F.lit(default))).drop("_own", "_node", "_class")
