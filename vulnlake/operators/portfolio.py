"""Portfolio assembly: many sources, one nested record a CVE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.links import once


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key, the one with the largest sequence number."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def attach(spine: DataFrame, source: DataFrame, key: str = "cve") -> DataFrame:
    """The spine's rows with the source's columns where it has the key; keys off the spine are left out."""
    return spine.join(source, key, "left")


def not_rejected(df: DataFrame, status: str) -> DataFrame:
    """Records whose status is anything but Rejected, or missing."""
    return df.where(F.coalesce(F.col(status), F.lit("")) != "Rejected")


def english(descriptions: Column) -> Column:
    """Value of the first description in English."""
    return F.try_element_at(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(1))["value"]


def cpe_parts(criteria: Column) -> Column:
    """struct(cpe, version, vendor, product, product_version); null with fewer than six parts."""
    p = F.split(criteria, ":")
    return F.when(F.size(p) >= 6, F.struct(criteria.alias("cpe"), F.concat(p[0], p[1]).alias("version"), p[3].alias("vendor"), p[4].alias("product"), p[5].alias("product_version")))


def cvss_block(nested: Column, flat: Column) -> Column:
    """Base score, vector and severity of a nested block if there is one, else of the flat record."""
    empty = lambda c: F.nullif(c, F.lit(""))
    pick = lambda a, b: F.when(nested.isNotNull(), empty(a)).otherwise(empty(b))
    return F.struct(pick(nested["score"], flat["score"]).alias("score"), pick(nested["vector"], flat["vector"]).alias("vector"), pick(nested["severity"], flat["severity"]).alias("severity"))


def cwe_values(weaknesses: Column) -> Column:
    """Weakness names in the order in which they are first seen, or the sentinel."""
    values = F.flatten(F.transform(weaknesses, lambda w: F.transform(w["description"], lambda d: d["value"])))
    joined = F.array_join(F.array_distinct(F.filter(values, lambda v: F.length(v) > 0)), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Not given"))


def primary_metric(*versions: Column) -> Column:
    """First entry of the first version that has one; versions come newest first."""
    return F.coalesce(*[F.try_element_at(v, F.lit(1)) for v in versions])


def by_role(items: DataFrame, key: str = "cve") -> DataFrame:
    """Patch and exploit sets: items without a role are patches."""
    role = F.coalesce("role", F.lit("patch"))
    own = lambda r: F.map_from_entries(F.array_sort(F.collect_list(F.when(role == r, F.struct("item", "record")))))
    return items.groupBy(key).agg(own("patch").alias("patch_set"), own("exploit").alias("exploit_set"))


def discussion(items: DataFrame, key: str = "cve") -> DataFrame:
    """Items that are talk: pulls, issues, advisories, and bulletins that say something."""
    talk = F.col("kind").isin("pull", "issue", "advisory") | ((F.col("kind") == "bulletin") & ((F.length("summary") > 0) | (F.length("details") > 0)))
    entry = F.struct("pos", "kind", "title")
    return items.where(talk).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


#: What a repository host's payloads may hold, of all kinds together.
ITEM_SCHEMA = (
    "sha string, commit struct<message string, author struct<name string, email string, date string>>, files array<struct<filename string, status string, additions long, deletions long, patch string>>, "
    "title string, body string, state string, merged boolean, merged_at string, closed_at string, user struct<login string>, labels array<struct<name string>>, head struct<sha string>, base struct<sha string>, "
    "ghsa_id string, cve_id string, summary string, description string, severity string, cvss string, cwe_ids array<string>, vulnerabilities string, published_at string, updated_at string, references array<string>, "
    "tag_name string, name string, full_name string, stargazers_count long, language string"
)


def item_record(kind: Column, payload: Column) -> Column:
    """One record of a repository host's item; which payload field fills which of its fields depends on the item's kind.

    Kinds are commit, pull, issue, advisory, release and repo; any other keeps its payload, as text, in `raw`.
    """

    def build(p: Column) -> Column:
        own = lambda **by: [F.when(kind == k, v) for k, v in by.items()]
        message, author = p["commit"]["message"], p["commit"]["author"]
        subject = F.nullif(F.regexp_extract(message, r"^([^\r\n]*)", 1), F.lit(""))
        labels = F.transform(p["labels"], lambda x: x["name"])
        files = F.transform(p["files"], lambda f: F.struct(f["filename"].alias("path"), f["status"].alias("status"), f["additions"].alias("additions"), f["deletions"].alias("deletions"), f["patch"].alias("patch")))
        state = F.when(p["merged"], F.lit("merged")).otherwise(p["state"])
        fields = {
            "title": own(commit=subject, pull=p["title"], issue=p["title"], advisory=F.coalesce(F.nullif(p["summary"], F.lit("")), p["title"])),
            "body": own(commit=message, pull=p["body"], issue=p["body"], advisory=p["description"], release=p["body"], repo=p["description"]),
            "state": own(pull=state, issue=p["state"]),
            "author": own(commit=author["name"], pull=p["user"]["login"], issue=p["user"]["login"]),
            "author_email": own(commit=author["email"]),
            "date": own(commit=author["date"], pull=p["merged_at"], issue=p["closed_at"], advisory=p["published_at"], release=p["published_at"]),
            "updated_at": own(advisory=p["updated_at"]),
            "labels": own(pull=labels, issue=labels),
            "sha": own(commit=p["sha"], pull=p["head"]["sha"]),
            "base": own(pull=p["base"]["sha"]),
            "files": own(commit=files),
            "ghsa_id": own(advisory=p["ghsa_id"]),
            "cve_id": own(advisory=p["cve_id"]),
            "severity": own(advisory=p["severity"]),
            "cvss": own(advisory=p["cvss"]),
            "cwe_ids": own(advisory=p["cwe_ids"]),
            "vulnerabilities": own(advisory=p["vulnerabilities"]),
            "references": own(advisory=p["references"]),
            "tag_name": own(release=p["tag_name"]),
            "name": own(release=p["name"], repo=p["full_name"]),
            "stars": own(repo=p["stargazers_count"]),
            "language": own(repo=p["language"]),
            "raw": [F.when(~kind.isin("commit", "pull", "issue", "advisory", "release", "repo"), payload)],
        }
        return F.struct(*[F.coalesce(*v).alias(name) for name, v in fields.items()])

    return once(F.from_json(payload, ITEM_SCHEMA), build)


#: Names under which an update guide's payload may have a field, the first that is filled counts.
_SCALARS = {
    "title": ["title", "name", "cveTitle"],
    "description": ["description", "executiveSummary", "summary", "tag"],
    "impact": ["impact"],
    "vuln_type": ["vulnType"],
    "publicly_disclosed": ["publiclyDisclosed"],
    "exploited": ["exploited", "publiclyDisclosed"],
    "exploitability_assessment": ["exploitabilityAssessment", "latestSoftwareRelease", "olderSoftwareRelease"],
    "mitre_url": ["mitreUrl"],
    "release_date": ["releaseDate", "releasedDate"],
    "last_modified": ["lastModifiedDate", "latestRevisionDate"],
}
#: Fixed values, as above: lists; parts of scores, products, remedies and references.
_LISTS = {
    "cwe": ["cweDetailsList", "cweList", "cwe"],
    "acknowledgements": ["acknowledgements", "credits"],
    "articles": ["articles"],
    "revisions": ["revisions"],
}
_CVSS = {"base_score": ["baseScore", "score", "value"], "vector": ["vector", "vectorString"], "severity": ["baseSeverity", "severity"], "temporal_score": ["temporalScore"], "vector_source": ["vectorStringSource"]}
_PRODUCTS = {"name": ["name", "productName", "product"], "platform": ["platform", "productFamily"]}
_REMEDIES = {"type": ["type", "remediationType"], "kb": ["kbArticle", "kb", "id"], "url": ["url", "downloadUrl"], "description": ["description", "fixedBuildNumber"]}
_REFERENCES = {"url": ["url", "href"], "label": ["label", "description", "title"]}
_VERSIONS, _AFFECTED = ["versions", "versionList"], ["products", "affectedProducts"]


def _pick(record: Column, names: list[str]) -> Column:
    """The first of a map's entries that holds something, as text."""
    filled = lambda v: F.when(~v.isin("", "null", "[]"), v)
    return F.coalesce(*[filled(F.try_element_at(record, F.lit(n))) for n in names])


def _fields(record: Column, names: dict[str, list[str]]) -> list[Column]:
    return [_pick(record, own).alias(name) for name, own in names.items()]


def _array(text: Column) -> Column:
    """Elements of a JSON array, as text; none if there is no array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _records(text: Column, use) -> Column:
    """use(map of its fields) of each element of a JSON array that is an object."""
    return F.transform(F.filter(_array(text), lambda x: x.startswith("{")), lambda x: once(F.from_json(x, "map<string,string>"), use))


def product_list(payload: Column) -> Column:
    return _records(_pick(payload, ["affectedProducts", "products"]), lambda p: F.struct(*_fields(p, _PRODUCTS), _array(_pick(p, _VERSIONS)).alias("versions")))


def remediation_list(payload: Column) -> Column:
    return _records(_pick(payload, ["remediations", "kbArticles"]), lambda r: F.struct(*_fields(r, _REMEDIES), _array(_pick(r, _AFFECTED)).alias("products")))


def reference_list(payload: Column) -> Column:
    """References may be plain addresses or objects."""

    def one(x: Column) -> Column:
        build = lambda record: F.struct(F.when(x.startswith("{"), _pick(record, _REFERENCES["url"])).otherwise(x).alias("url"), F.when(x.startswith("{"), _pick(record, _REFERENCES["label"])).alias("label"))
        return once(F.from_json(F.when(x.startswith("{"), x), "map<string,string>"), build)

    return F.transform(_array(_pick(payload, ["references", "externalReferences"])), one)


def guide_record(cve: Column, payload: Column) -> Column:
    """The 21 fields of an update guide's record from its JSON payload; values stay text, lists stay lists."""

    def build(p: Column) -> Column:
        nested = _pick(p, ["cvssScoreSets", "cvssV3", "cvss"])
        nested = F.when(nested.startswith("["), F.try_element_at(_array(nested), F.lit(1))).otherwise(nested)
        scores = F.when(nested.startswith("{"), F.from_json(nested, "map<string,string>")).otherwise(p)
        scalars = {name: _pick(p, names) for name, names in _SCALARS.items()}
        lists = {name: _array(_pick(p, names)) for name, names in _LISTS.items()}
        return F.struct(
            F.lit("msrc.microsoft.com").alias("source"),
            F.concat(F.lit("https://msrc.microsoft.com/update-guide/vulnerability/"), cve).alias("url"),
            F.lit("patch").alias("role"),
            *[v.alias(k) for k, v in scalars.items() if k != "exploited"],
            F.coalesce(scalars["exploited"], F.lit("false")).alias("exploited"),
            once(scores, lambda s: F.struct(*_fields(s, _CVSS))).alias("cvss"),
            *[v.alias(k) for k, v in lists.items()],
            product_list(p).alias("affected_products"),
            remediation_list(p).alias("remediations"),
            reference_list(p).alias("references"),
        )

    return once(F.from_json(payload, "map<string,string>"), build)
