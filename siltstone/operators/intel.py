"""Threat intelligence: names, authors, indicators, reputation, campaigns; feeds that supply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import any_contains, explode_lines, pinned
from siltstone.rules import packs
from siltstone.rules.fold import JAVA, any_of, folded
from siltstone.sources.packages import reference_json

INDICATORS = [(p, s, k, x) for p, s, xs in packs.INDICATORS for k, x in enumerate(xs)]
MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Broadcast a table after checking its size; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def name_matches(packages: DataFrame, names: DataFrame, typos: DataFrame) -> DataFrame:
    """``pkg_id, kind, match``: a listed name (case aside), else the first typosquat pattern in list order.

    A pattern matches where one of name and pattern starts with the other, or
    where they are equal but for hyphens. Blank names match nothing.
    """
    p = packages.select("pkg_id", F.lower(F.trim("name")).alias("n")).where("n <> ''")
    known = p.join(small(names.select(F.lower("name").alias("n")).distinct()), "n", "left_semi").select("pkg_id", F.lit("known").alias("kind"), F.col("n").alias("match"))
    rest = p.join(known, "pkg_id", "left_anti")
    t = typos.select("ord", F.lower("pattern").alias("t")).where("t <> ''")
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i)))
    # each way to match is an equality, so lists of any size meet by hash
    ways = [
        rest.select("pkg_id", starts("n").alias("k")).join(t.withColumn("k", F.col("t")), "k"),
        rest.withColumn("k", F.col("n")).join(t.select("ord", "t", starts("t").alias("k")), "k"),
        rest.withColumn("k", bare("n")).join(t.withColumn("k", bare("t")), "k"),
    ]
    hit = reduce(DataFrame.unionByName, [w.select("pkg_id", "ord", "t") for w in ways])
    return known.unionByName(hit.groupBy("pkg_id").agg(F.lit("typosquat").alias("kind"), F.min_by("t", "ord").alias("match")))


def author_matches(packages: DataFrame, authors: DataFrame) -> DataFrame:
    return packages.select("pkg_id", "author", F.lower("author").alias("a")).join(small(authors.select(F.lower("author").alias("a")).distinct()), "a").select("pkg_id", "author")


def ioc_hits(f: DataFrame, iocs: list[str] = packs.IOC) -> DataFrame:
    """``file_id, ioc, kind``: case-sensitive containment; the list is folded into the plan, one search an entry."""
    found = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), F.lit(x)) for x in iocs]))
    h = f.where(~reference_json(F.col("name"))).select("file_id", F.explode(found).alias("ioc"))
    return h.withColumn("kind", F.when(F.col("ioc").rlike(r"^\d"), "c2").otherwise("hosting"))


def rule_line(line: Column) -> Column:
    return F.trim(line).rlike(JAVA + any_of(packs.RULE_LINE))


def not_executable(line: Column) -> Column:
    """The line explains, labels or configures rather than acts."""
    s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    low = F.lower(s)
    clauses = [
        any_contains(low, packs.TRUSTED) & s.rlike(any_of(packs.ENV_READ)),
        s.rlike(r"^(?:#|//|- |\* )"),
        s.rlike(r"st\.(?:markdown|text|header|subheader|caption)\s*\(|(?:label|desc(?:ription)?|help|placeholder|title)\s*=\s*[\"']"),
        s.startswith("| ") & s.contains("`"),
        s.rlike("allowed-tools|forbidden-tools"),
        low.contains("postinstall") & (low.contains("npm") | low.contains("node_modules")),
        s.contains(".env.example") | s.contains(".env.sample"),
        s.rlike(r"os\.environ\.(?:items|copy|keys|values)\s*\("),
        s.rlike(r"^(?:async\s+)?function\s+\w+\s*\("),
        s.rlike("^[\"']") & ~s.rlike("def |class |import |return |if |for |while "),
        s.contains(".get(") & s.rlike("'(?:token|secret|key|auth)'"),
        s.startswith("echo ") & s.rlike("Secret|secret|token"),
        s.rlike("'(?:item|status|action|risk|fix_cmd|required)':"),
        s.rlike(r"\.get\(['\"]\w+_?(?:secret|token|key|api)['\"]") & s.rlike(r"json\.loads?|yaml\.load|config\[|data\["),
    ]
    return reduce(lambda a, b: a | b, clauses)


EXFIL_TYPE = ["config_exfiltration", "credential_harvesting", "webhook_exfiltration"]


def line_flags(line: Column) -> dict[str, Column]:
    """What a line says for its severity: an environment read, a value taken with ``get``, from a parsed configuration, a count of a model's tokens."""
    s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    return {"env": s.rlike(any_of(packs.ENV_READ)), "got": s.rlike(packs.CONFIG_GET), "config": any_contains(s, packs.CONFIG_SOURCE), "model": F.contains(F.lower(s), F.lit("token")) & s.rlike(JAVA + any_of(packs.MODEL_TOKENS))}


def downgraded(base: Column, pattern_id: Column, indicator: Column, trusted: Column, chain: Column, at: Column) -> Column:
    """Severity in context, the first that holds: a trusted domain in the file and an environment read on the line; a trusted
    domain and a pattern of exfiltration; a value taken from a parsed configuration; a broad indicator that counts a model's
    tokens (all INFO), or that stands in a file that doesn't both read files and send (MEDIUM at most)."""
    return (
        F.when(trusted & at["env"], "INFO")
        .when(trusted & pattern_id.isin(*EXFIL_TYPE), "INFO")
        .when(at["got"], F.when(at["config"], "INFO").otherwise(base))
        .when((indicator == "token") & at["model"], "INFO")
        .when(indicator.isin(*packs.BROAD) & ~chain & base.isin("CRITICAL", "HIGH"), "MEDIUM")
        .otherwise(base)
    )


def attack_patterns(f: DataFrame, trusted: list[str] = packs.TRUSTED) -> DataFrame:
    """``file_id, pattern_id, severity, indicator, line_no``: per file and pattern the first indicator in list order on its first line that acts; severity in context (``downgraded``)."""
    lits = sorted({x.lower() for _, _, _, x in INDICATORS})
    src = pinned(f.where(~reference_json(F.col("name"))), "low", folded(F.col("text"))).where(any_contains(F.col("low"), lits))
    t = F.col("text")
    flags = {"trusted": any_contains(F.col("low"), trusted), "chain": any_contains(t, packs.READS_FILE) & any_contains(t, packs.SENDS)}
    rows = explode_lines(src.select("file_id", "text", *[c.alias(k) for k, c in flags.items()]))
    rows = pinned(rows, "_ll", folded(F.col("line")))
    low = F.col("_ll")
    ix = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x.lower())), F.lit(k)) for k, (_, _, _, x) in enumerate(INDICATORS)]))
    rows = rows.where(any_contains(low, lits)).where(~rule_line(F.col("line")) & ~not_executable(F.col("line")))
    # the line goes no further than what it says
    rows = pinned(rows, "at", F.struct(*[c.alias(k) for k, c in line_flags(F.col("line")).items()])).withColumn("ix", F.explode(ix))
    pick = lambda k: F.element_at(F.array(*[F.lit(i[k]) for i in INDICATORS]), F.col("ix") + 1)
    best = rows.withColumn("pattern_id", pick(0)).groupBy("file_id", "pattern_id").agg(F.min(F.struct("ix", "line_no", "at")).alias("b"), *[F.first(k).alias(k) for k in flags])
    best = best.withColumn("ix", F.col("b.ix")).withColumn("indicator", pick(3))
    sev = downgraded(pick(1), F.col("pattern_id"), F.col("indicator"), F.col("trusted"), F.col("chain"), F.col("b.at"))
    return best.select("file_id", "pattern_id", sev.alias("severity"), "indicator", F.col("b.line_no").alias("line_no"))


def ip_number(ip: Column) -> Column:
    """IPv4 as a number; null where an octet exceeds 255 or the form is another."""
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(p, lambda x: x <= 255)
    return F.when(ok, F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a network."""
    n = ip_number(F.regexp_extract(cidr, r"^([\d.]+)", 1))
    bits = F.coalesce(F.regexp_extract(cidr, r"/(\d{1,2})$", 1).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    lo = (F.floor(n / size) * size).cast("long")
    return lo, lo + size - 1


def in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Addresses in any of the networks: a range join by way of their common /8 (networks wider than that are spread over theirs)."""
    lo, hi = cidr_range(F.col("cidr"))
    n = networks.select("cidr", lo.alias("lo"), hi.alias("hi")).where("lo IS NOT NULL")
    n = n.withColumn("k", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    a = addresses.withColumn("_n", ip_number(F.col("ip"))).withColumn("k", F.shiftright("_n", 24))
    return a.join(n, "k").where("_n BETWEEN lo AND hi").drop("k", "_n", "lo", "hi")


RESERVED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4"]


def without_reserved(networks: DataFrame, spark: SparkSession) -> DataFrame:
    """Networks that overlap no reserved range (nine constants)."""
    lo, hi = cidr_range(F.col("cidr"))
    r = spark.createDataFrame([(x,) for x in RESERVED], "cidr string").select(lo.alias("rlo"), hi.alias("rhi"))
    n = networks.withColumn("lo", lo).withColumn("hi", hi).where("lo IS NOT NULL")
    return n.join(F.broadcast(r), (F.col("lo") <= F.col("rhi")) & (F.col("rlo") <= F.col("hi")), "left_anti").drop("lo", "hi")


NOT_DOMAIN = "exe|dll|zip|tar|gz|py|js|mjs|sh|json|yaml|yml|toml|md|txt|html|css|png|jpg|svg|conf|cfg|log|bin|pem|lock|map|env|example|local|test|internal"


DOMAIN = r"(?:://|@)((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,6})"


def domains_and_ips(f: DataFrame) -> DataFrame:
    """``kind, value``: valid IPv4 literals and domain names in texts, distinct."""
    ip = F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])"), F.lit(1)), lambda x: F.struct(F.lit("ip").alias("kind"), x.alias("value")))
    dom = F.transform(F.regexp_extract_all("text", F.lit(DOMAIN), F.lit(1)), lambda x: F.struct(F.lit("domain").alias("kind"), F.lower(x).alias("value")))
    t = f.where(F.col("text").rlike(r"\d\.\d|://|@")).select(F.explode(F.concat(ip, dom)).alias("t")).select("t.*").distinct()
    return t.where(((F.col("kind") == "ip") & ip_number(F.col("value")).isNotNull()) | ((F.col("kind") == "domain") & ~F.col("value").rlike(rf"\.(?:{NOT_DOMAIN})$")))


def read_feed(spark: SparkSession, path: str, form: str, column: str = "value", least: int = 5) -> DataFrame:
    """Local feed files as ``value``: csv, json, text, cidr_text or ipsum (address and count, at least ``least``). Lower case, distinct."""
    if form == "csv":
        v = spark.read.option("header", True).option("comment", "#").csv(path).select(F.col(column).alias("value"))
    elif form == "json":
        v = spark.read.option("multiLine", True).json(path).select(F.col(column).alias("value"))
    else:
        t = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
        if form == "cidr_text":
            v = t.select(F.regexp_extract("value", r"(\d{1,3}(?:\.\d{1,3}){3}/\d{1,2})", 1).alias("value")).where("value <> ''")
        elif form == "ipsum":
            v = t.select(F.split("value", r"\s+").alias("p")).where(F.get("p", F.lit(1)).try_cast("int") >= least).select(F.col("p")[0].alias("value"))
        else:
            v = t
    return v.select(F.lower("value").alias("value")).where("value IS NOT NULL").distinct()


def merge_feed(current: DataFrame, new: DataFrame) -> DataFrame:
    """``value, is_new``: the union, and what the feed adds."""
    c = current.select(F.lower("value").alias("value")).distinct().withColumn("old", F.lit(True))
    return new.select(F.lower("value").alias("value")).distinct().join(c, "value", "full").select("value", F.col("old").isNull().alias("is_new"))


# Execution chains of known campaigns, in order.
CHAINS = [
    r"curl[^\n]*\|\s*(?:ba)?sh", r"base64\s+-[dD][^\n]*\|\s*(?:ba)?sh", r"xattr\s+-[cd][^\n]*(?:\n[^\n]*){0,3}chmod\s+\+x", r"wget[^\n]*&&[^\n]*chmod\s+\+x", r"powershell[^\n]*-enc",
]


def campaign_patterns(f: DataFrame) -> DataFrame:
    """``pkg_id, pattern``: generated-looking names, more than three packages with one name prefix, execution chains in files."""
    pk = f.select("pkg_id").distinct()
    named = pk.where(F.col("pkg_id").rlike(r"^[a-z0-9]+-[a-f0-9]{5}$")).select("pkg_id", F.lit("hex_suffix").alias("pattern"))
    pre = pk.withColumn("prefix", F.split("pkg_id", "-")[0]).where(F.col("pkg_id").contains("-"))
    crowd = pre.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    same = pre.join(crowd, "prefix").select("pkg_id", F.lit("shared_prefix").alias("pattern"))
    chain = f.where(F.col("text").rlike("(?i)" + any_of(CHAINS))).select("pkg_id", F.lit("execution_chain").alias("pattern")).distinct()
    return named.unionByName(same).unionByName(chain)
