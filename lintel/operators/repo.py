"""Repository snapshots from receipts, and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.text import byte_size
from lintel.functions.urls import repository

REPOSITORY = "full_name string, html_url string, description string, language string, stargazers_count long, forks_count long, open_issues_count long, default_branch string, topics array<string>, license struct<spdx_id:string>"
README = "name string, path string, html_url string, content string"
ENTRY = "struct<name:string,path:string,type:string,size:long,html_url:string>"


def snapshots(urls: DataFrame, receipts: DataFrame, url_col: str = "url") -> DataFrame:
    """Three receipts joined: the repository's record, its readme (base64) and its root listing, folders first."""
    api = F.concat(F.lit("https://api.github.com/repos/"), F.col("repo"))
    asked = urls.select(F.col(url_col).alias("source_url"), repository(F.col(url_col)).alias("repo")).where("repo is not null")
    body = receipts.select(F.col("url"), F.col("body").cast("string").alias("body"))

    def part(name: str, address: Column) -> DataFrame:
        return asked.select("source_url", address.alias("url")).join(body, "url").select("source_url", F.col("body").alias(name))

    joined = asked.join(part("r", api), "source_url").join(part("m", F.concat(api, F.lit("/readme"))), "source_url", "left").join(part("t", F.concat(api, F.lit("/contents"))), "source_url", "left")
    record, readme = F.from_json("r", REPOSITORY), F.from_json("m", README)
    tree = F.coalesce(F.from_json("t", f"array<{ENTRY}>"), F.array().cast(f"array<{ENTRY}>"))
    made = joined.select("source_url", record.alias("repository"), readme.alias("readme"), tree.alias("tree"))
    text = F.expr("cast(try_to_binary(regexp_replace(readme.content, '\\\\s+', ''), 'base64') as string)")
    ordered = F.array_sort(F.col("tree"), lambda a, b: F.when((a["type"] == "dir") != (b["type"] == "dir"), F.when(a["type"] == "dir", -1).otherwise(1)).when(F.lower(a["name"]) < F.lower(b["name"]), -1).when(F.lower(a["name"]) > F.lower(b["name"]), 1).otherwise(0))
    return made.withColumn("readme", F.when(F.col("readme").isNotNull(), F.struct("readme.name", "readme.path", "readme.html_url", text.alias("content")))).withColumn("tree", ordered)


def _label(t: Column) -> Column:
    return F.when(t["type"] == "dir", F.concat(t["name"], F.lit("/"))).otherwise(t["name"])


def _size(t: Column) -> Column:
    return F.when((t["type"] == "file") & t["size"].isNotNull(), F.concat(F.lit(" ("), byte_size(t["size"]), F.lit(")"))).otherwise("")


def _facts(prefix: str, code: str) -> list[Column]:
    r = lambda name: F.col(f"repository.{name}")
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"{prefix}{label}: "), value))
    number = lambda label, name: line(label, F.format_number(r(name), 0))
    return [
        F.concat(F.lit(f"{prefix}URL: "), F.coalesce(r("html_url"), F.col("source_url"))), F.concat(F.lit(f"{prefix}Default branch: {code}"), r("default_branch"), F.lit(code)),
        line("Primary language", r("language")), number("Stars", "stargazers_count"), number("Forks", "forks_count"), number("Open issues", "open_issues_count"),
        line("License", F.col("repository.license.spdx_id")), line("Topics", F.when(F.size(r("topics")) > 0, F.array_join(r("topics"), ", "))),
    ]


def _readme() -> Column:
    return F.coalesce(F.rtrim("readme.content"), F.lit("README content was not returned by the GitHub API."))


def as_markdown() -> Column:
    """Of a row of ``snapshots``."""
    files = F.transform("tree", lambda t: F.concat(F.lit("- ["), _label(t), F.lit("]("), t["html_url"], F.lit(")"), _size(t)))
    head = F.concat_ws("\n", F.concat(F.lit("# "), "repository.full_name"), F.lit(""), F.concat(F.lit("> "), "repository.description"), F.lit(""), F.lit("## Repository"), F.lit(""), *_facts("- ", "`"), F.lit(""), F.lit("## Files"), F.lit(""))
    listed = F.when(F.size("tree") > 0, F.array_join(files, "\n")).otherwise("- No root files returned by the GitHub API.")
    return F.concat_ws("\n", head, listed, F.lit(""), F.concat(F.lit("## "), F.coalesce("readme.path", F.lit("README"))), F.lit(""), _readme(), F.lit(""))


def as_text() -> Column:
    files = F.transform("tree", lambda t: F.concat(F.lit("- "), _label(t), _size(t)))
    head = F.concat_ws("\n", F.concat(F.lit("Repository: "), "repository.full_name"), F.concat(F.lit("Description: "), "repository.description"), *_facts("", ""), F.lit(""), F.lit("Files:"))
    listed = F.when(F.size("tree") > 0, F.array_join(files, "\n")).otherwise("- No root files returned by the GitHub API.")
    return F.concat_ws("\n", head, listed, F.lit(""), F.concat(F.coalesce("readme.path", F.lit("README")), F.lit(":")), F.lit(""), _readme(), F.lit(""))
