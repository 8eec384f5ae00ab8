"""URL filters: rules found by their rarest literal token; a regular expression runs only where a URL holds the token.

Rules are patterns over `//host/path?query#fragment` with the host's A-Z lower-cased: `*` stands for any text, `^` for a
separator or the end, a leading `||` for the start of the host or of one of its parent domains, a leading or trailing `|`
for the start or end. A literal token is a run of letters and digits that the pattern bounds on both sides, so a URL can
only match if the run is one of its own tokens. Of a rule's tokens the one that fewest URLs hold becomes its index key;
a rule without any is tried on every URL.

Rules of tier 0 fit before those of tier 1 (and so on); in a tier the longest pattern wins, then `allow` before `block`,
then the first in code-point order. Where no rule fits, or a URL is null or has no `://`, the verdict is `allow`.

Inputs: the URL column may hold nulls, empty and very long texts; other columns stay, whatever their names (those of the
result replace columns of the same name). Repeated rows are judged alike and all stay. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.llm.common import delete_saved, save, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pattern rules for pages that carry no text of their own: sessions, forms, carts, machine listings, wagers and adult sites.
PATTERNS = {
    "block": [
        "^phpsessid=", "^jsessionid=", "^sessionid=", "^replytocom=", "^action=edit^", "^action=history^",
        "/login^", "/signin^", "/signup^", "/register^", "/wp-login.php^", "/cart^", "/checkout^", "/account^",
        "/search^", "/tag/*/page/", "/calendar/*/*/", "/feed/|", "/trackback/|", "/xmlrpc.php^",
        "||*casino*^", "/casino^", "-casino-", "||*poker*^", "||porn*^", "||xxx*^", "/adult/",
    ],
    "allow": ["/help/login^", "/wiki/casino^"],
}


def rules(spark: SparkSession, patterns: dict[str, list[str]], tier: int = 0) -> DataFrame:
    """(pattern, verdict, tier) of patterns by verdict; larger lists can come from any table of this form."""
    rows = [F.struct(F.lit(p).alias("pattern"), F.lit(v).alias("verdict"), F.lit(tier).alias("tier")) for v, ps in patterns.items() for p in ps]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_rules(spark: SparkSession, fits: dict[str, str]) -> DataFrame:
    """Rules `host/path` that fit the host with its subdomains and paths that start with the given one."""
    return rules(spark, {v: [f"||{r}" for r, w in fits.items() if w == v] for v in set(fits.values())})


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def address(url: Column) -> Column:
    """What patterns are matched with; null without `://`."""
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("//"), host(url), F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(.*)", 1)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[0-9a-z]+"), F.lit(0)))


def compiled(given: DataFrame) -> DataFrame:
    """Rules with `regex` and `literals`, the tokens that every matching address holds."""
    body = F.regexp_replace("pattern", r"^\|\|?|\|$", "")
    plain = F.regexp_replace(body, r"([\\.+?()\[\]{}$|])", r"\\$1")
    plain = F.replace(F.replace(plain, F.lit("^"), F.lit(r"(?:[^0-9A-Za-z_.%-]|\z)")), F.lit("*"), F.lit(".*"))
    head = F.when(F.startswith("pattern", F.lit("||")), r"^//(?:[^/?#]*\.)?").when(F.startswith("pattern", F.lit("|")), "^").otherwise("")
    tail = F.when(F.endswith("pattern", F.lit("|")) & (F.length("pattern") > 1), r"\z").otherwise("")
    bounded = F.regexp_extract_all(F.translate("pattern", UPPER, LOWER), F.lit("(?<=[^0-9a-z*])[0-9a-z]+(?=[^0-9a-z*])"), F.lit(0))
    return given.select("pattern", "verdict", "tier", F.concat(F.lit("(?s)"), head, plain, tail).alias("regex"), F.array_distinct(bounded).alias("literals"))


def indexed(given: DataFrame, urls: DataFrame) -> DataFrame:
    """Compiled rules with `token`, the literal that fewest of all `urls` (address) hold; null for a rule without one."""
    rule = compiled(given.distinct())
    each = rule.select("pattern", F.explode("literals").alias("token"))
    wanted = save(each.select("token").distinct())
    held = urls.select(F.explode(tokens(F.col("address"))).alias("token")).join(small(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(held, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least"))
    out = save(rule.join(rarest, "pattern", "left").select("pattern", "verdict", "tier", "regex", F.col("least.token").alias("token")))
    delete_saved(wanted)
    return out


def judge(df: DataFrame, given: DataFrame, column: str = "url") -> DataFrame:
    """`df` with host, path, pattern (the rule that decided, else null), tier and verdict.

    Each distinct address is judged once. Few rules (`common.small`) are broadcast to the tokens; more are joined by token.
    The addresses that a rule fits, with their best rule, are kept in the shared folder and joined back, by broadcast if
    few; else by the address, where adaptive execution splits an address that many rows share.
    """
    where = address(F.col(f"`{column}`"))
    urls = df.select(where.alias("address")).where("address is not null")
    rule = indexed(given, urls)
    by_token = urls.select("address", F.explode(F.concat(F.array(F.lit("")), tokens(F.col("address")))).alias("token"))
    keyed = rule.select("pattern", "verdict", "tier", "regex", F.coalesce("token", F.lit("")).alias("token"))
    fits = by_token.join(small(keyed), "token").where("address rlike regex")
    best = F.min(F.struct("tier", (-F.length("pattern")).alias("short"), (F.col("verdict") != "allow").alias("blocks"), "pattern", "verdict")).alias("best")
    found = save(fits.groupBy("address").agg(best).select("address", "best.pattern", "best.tier", "best.verdict"))
    names = ("host", "path", "pattern", "tier", "verdict")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], host(F.col(f"`{column}`")).alias("host"), path(F.col(f"`{column}`")).alias("path"), where.alias("_address"))
    out = kept.join(small(found), F.col("_address") == F.col("address"), "left").drop("_address", "address")
    return out.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit("allow"))})
