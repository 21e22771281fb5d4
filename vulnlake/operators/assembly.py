"""One nested portfolio a CVE from any number of sources, in one shuffle; and the evidence documents of stored portfolios.

Every source becomes facts: (cve, seq, section, source, item, sub, pos, value), value a VARIANT.  All facts are unioned, dealt by
the CVE once, and folded level by level: sub-items into items, items into sources, sources into sections.  Each level
groups by the CVE and more, so the partitioning by the CVE serves all of them and no join is needed.

A fact that is given again for the same place counts as its last writing says (largest seq; of equal ones the larger pos).
Facts of a CVE that has no fact of the section `spine` are left out.  A null CVE is left out.  A portfolio is one row, so it is held by one
task; `parts` deals each CVE's items over that many rows where single CVEs are too large for a row, each of them a portfolio
with a share of the items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import code
from vulnlake.functions import text as tx
from vulnlake.operators.portfolio import cpe_parts, cwe_values

FACT = ["cve", "seq", "section", "source", "item", "sub", "pos", "value"]
_WEAKNESS = "struct<source:string,type:string,description:array<struct<lang:string,value:string>>>"
_ENTRY = "struct<type:string,url:string,title:string,body:string,state:string,summary:string,details:string>"
_COMMENT = "struct<comment_id:string,content:string,author:string,date:string>"
_BUG = f"struct<bug_id:string,comments:array<{_COMMENT}>>"
#: Fixed value: a distribution's text that repeats the first source's.
SAME = "same as nvd"
#: Fields of an item that make its text, in order.
TEXT_FIELDS = ["title", "subject", "message", "description", "summary", "vulnerability_details", "remediation", "workarounds", "body", "name", "state"]
#: Fields of a discussion's entry that make its text, in order.
ENTRY_FIELDS = ["title", "summary", "details", "body", "state", "url"]
#: Kinds of a repository host's items that are talk.
TALK = ["pull", "issue", "advisory"]


def facts(df: DataFrame, section: str | Column, source: str | Column, value: Column, item: Column | None = None, sub: Column | None = None, pos: Column | None = None, keep: Column | None = None) -> DataFrame:
    """Facts of a table that has cve and seq; those with a null value or keep not true are left out."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    blank = F.lit("")
    rows = df if keep is None else df.where(keep)
    return rows.select("cve", F.col("seq").cast("long").alias("seq"), as_col(section).alias("section"), as_col(source).alias("source"), (blank if item is None else item.cast("string")).alias("item"), (blank if sub is None else sub.cast("string")).alias("sub"), (F.lit(0) if pos is None else pos).cast("long").alias("pos"), value.alias("value")).where("cve is not null and value is not null")


def _variant(c: Column) -> Column:
    return F.to_variant_object(F.struct(c.alias("v")))


def _object(**fields: Column) -> Column:
    return F.to_variant_object(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _text(v: Column, path: str = "$") -> Column:
    """A field as text: a string as it is, anything else as JSON; null if it is missing or JSON null."""
    return F.try_variant_get(v, path, "string")


def spine_facts(records: DataFrame, source: str = "nvd") -> DataFrame:
    """(cve, seq, record VARIANT) of the source that says which CVEs there are: description, weaknesses, metrics, configurations."""
    r = F.col("record")
    spine = facts(records, "spine", source, F.parse_json(F.lit("true")))
    described = facts(records, "description", source, _variant(_text(r, "$.descriptions[0].value")), keep=_text(r, "$.descriptions[0].value").isNotNull())
    weak = records.select("cve", "seq", F.posexplode(F.try_variant_get(r, "$.weaknesses", "array<variant>")).alias("i", "w"))
    metrics = facts(records, "cvss", source, F.try_variant_get(r, "$.metrics", "variant"))
    nodes = records.select("cve", "seq", F.posexplode(F.try_variant_get(r, "$.configurations", "array<variant>")).alias("i", "c"))
    matches = nodes.select("cve", "seq", "i", F.posexplode(F.try_variant_get("c", "$.nodes[0].cpeMatch", "array<variant>")).alias("j", "m"))
    named = matches.withColumn("criteria", _text(F.col("m"), "$.criteria"))
    cpe = facts(named, "cpe", source, F.to_variant_object(cpe_parts(F.col("criteria"))), F.col("criteria"), pos=F.col("i") * 1_000_000 + F.col("j"), keep=F.size(F.split("criteria", ":")) >= 6)
    return reduce(DataFrame.unionAll, [spine, described, facts(weak, "cwe", source, F.col("w"), F.col("i"), pos=F.col("i")), metrics, cpe])


def distribution_facts(records: DataFrame, source: str, score_fields: list[str], notes: str | None = None, note_type: str = "team_notes") -> DataFrame:
    """(cve, seq, record VARIANT) of a distribution: its description unless it repeats the spine's, scores, notes."""
    r = F.col("record")
    said = _text(r, "$.description")
    out = [facts(records, "description", source, _variant(said), pos=F.lit(1), keep=said.isNotNull() & (said != SAME)), facts(records, "cvss", source, _object(**{f: _text(r, f"$.{f}") for f in score_fields}), pos=F.lit(1))]
    if notes:
        own = _text(r, f"$.{notes}")
        out.append(facts(records, "discussion", source, _object(type=F.lit(note_type), value=F.array(own)), keep=F.length(own) > 0))
    return reduce(DataFrame.unionAll, out)


def bug_facts(comments: DataFrame, source: str) -> DataFrame:
    """(cve, seq, bug_id, comment_id, content, author, date): comments of trackers, kept in the order of seq under their bugs."""
    value = _object(comment_id=F.col("comment_id").cast("string"), content=F.col("content"), author=F.col("author"), date=F.col("date").cast("string"))
    return facts(comments, "bug", source, value, F.col("bug_id"), F.col("comment_id"), F.col("seq"))


def file_facts(files: DataFrame, source: str, section: str = "exploit") -> DataFrame:
    """(cves, seq, fileid, title, content): files that name several CVEs, each of which gets them."""
    rows = files.withColumn("cve", F.explode("cves"))
    return facts(rows, section, source, _object(source=F.lit(source), title=F.col("title"), content=F.col("content")), F.col("fileid"), pos=F.col("seq"))


def guide_facts(records: DataFrame, source: str) -> DataFrame:
    """(cve, seq, record VARIANT) of an update guide: one record a CVE; thanks count as talk; its role says which set it goes to."""
    r = F.col("record")
    thanks = F.try_variant_get(r, "$.acknowledgements", "array<string>")
    item = _object(source=F.lit(source), **{f: _text(r, f"$.{f}") for f in ("title", "description", "release_date", "last_modified", "exploited")}, references=F.try_variant_get(r, "$.references", "variant"), remediations=F.try_variant_get(r, "$.remediations", "variant"))
    said = _text(r, "$.description")
    return reduce(DataFrame.unionAll, [
        facts(records, "description", source, _variant(said), pos=F.lit(2), keep=F.length(said) > 0),
        facts(records, "cvss", source, F.try_variant_get(r, "$.cvss", "variant"), pos=F.lit(2)),
        facts(records, "discussion", source, _object(type=F.lit("acknowledgements"), value=thanks), keep=F.size(thanks) > 0),
        facts(records, F.when(_text(r, "$.role") == "patch", "patch").otherwise("exploit"), source, item, _text(r, "$.url"), pos=F.col("seq")),
    ])


def item_facts(items: DataFrame, source: str, scores: bool = False) -> DataFrame:
    """(cve, seq, record VARIANT) of a source with several items a CVE: by role (patch, if it has none) and url; talk and scores beside."""
    r = F.col("record")
    role, kind, url = F.coalesce(_text(r, "$.role"), F.lit("patch")), _text(r, "$.kind"), _text(r, "$.url")
    summary, details = _text(r, "$.summary"), _text(r, "$.vulnerability_details")
    bulletin = (F.length(summary) > 0) | (F.length(details) > 0)
    entry = _object(type=F.when(kind.isin(TALK), kind).otherwise("bulletin"), url=url, title=_text(r, "$.title"), body=_text(r, "$.body"), state=_text(r, "$.state"), summary=F.when(~F.coalesce(kind.isin(TALK), F.lit(False)), summary), details=F.when(~F.coalesce(kind.isin(TALK), F.lit(False)), details))
    out = [facts(items, F.when(role == "patch", "patch").otherwise("exploit"), source, r, url, pos=F.col("seq")), facts(items, "entry", source, entry, url, pos=F.col("seq"), keep=kind.isin(TALK) | bulletin)]
    if scores:
        out.append(facts(items, "cvss", source, F.try_variant_get(r, "$.cvss", "variant"), pos=F.lit(3), keep=kind == "advisory"))
    return reduce(DataFrame.unionAll, out)


def location_facts(records: DataFrame) -> DataFrame:
    """(cve, seq, record VARIANT): where the flaw is, by tag; a tag's value may be a text, a list, or an object of texts."""
    rows = records.select("cve", "seq", F.posexplode(F.try_variant_get("record", "$", "map<string,variant>")).alias("i", "tag", "v"))
    return facts(rows, "location", "location", F.col("v"), F.col("tag"), pos=F.col("i"))


def _ordered(c: Column, key: str) -> Column:
    """An array of structs by (pos, key); a comparison, since variants have no order."""
    rank = lambda a, b, f, then: F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(then)
    return F.array_sort(c, lambda a, b: rank(a, b, "pos", rank(a, b, key, F.lit(0))))


def assemble(sources: list[DataFrame], parts: int = 1) -> DataFrame:
    """(cve, part, description, cwe, developer_discussion, cvss, cpe, exploit_set, patch_set, location), one row a CVE and part."""
    rows = reduce(DataFrame.unionAll, [s.select(*FACT) for s in sources])
    whole = F.col("section").isin("spine", "description", "cwe")
    rows = rows.withColumn("part", F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("section", "source", "item"), F.lit(parts))).cast("int"))
    if parts > 1:  # every part needs the spine, or it would be left out
        more = rows.where("section = 'spine'").drop("part").withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))))
        rows = rows.unionByName(more)
    key = ["cve", "part"]
    placed = rows.repartition(*key)
    last = placed.groupBy(*key, "section", "source", "item", "sub").agg(F.max_by(F.struct("pos", "value"), F.struct("seq", "pos")).alias("v"))
    items = last.groupBy(*key, "section", "source", "item").agg(F.min("v.pos").alias("pos"), F.collect_list(F.struct(F.col("v.pos").alias("pos"), "sub", F.col("v.value").alias("value"))).alias("subs"))
    by_source = items.groupBy(*key, "section", "source").agg(F.min("pos").alias("pos"), F.collect_list(F.struct("pos", "item", "subs")).alias("items"))
    of = lambda s: F.collect_list(F.when(F.col("section") == s, F.struct("pos", "source", "items")))
    names = ["spine", "description", "cwe", "discussion", "entry", "bug", "cvss", "cpe", "exploit", "patch", "location"]
    nested = by_source.groupBy(*key).agg(*[of(s).alias(s) for s in names]).where(F.size("spine") > 0)
    return nested.select(*key, *_typed())


def _typed() -> list[Column]:
    """The sections' types of a portfolio from lists of (pos, source, items)."""
    only = lambda items: items[0]["subs"][0]["value"]
    sources = lambda name: _ordered(F.col(name), "source")
    values = lambda items: F.transform(_ordered(items, "item"), lambda i: i["subs"][0]["value"])
    keyed = lambda items: F.map_from_entries(F.transform(_ordered(items, "item"), lambda i: F.struct(i["item"], i["subs"][0]["value"])))
    by_source = lambda name, use: F.map_from_entries(F.transform(sources(name), lambda s: F.struct(s["source"], use(s["items"]))))
    bugs = lambda items: F.transform(_ordered(items, "item"), lambda i: F.struct(i["item"].alias("bug_id"), F.transform(_ordered(i["subs"], "sub"), lambda c: F.try_variant_get(c["value"], "$", _COMMENT)).alias("comments")))
    talk = F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda s: s["source"]) for c in ("discussion", "entry", "bug")])))
    own = lambda name, source: F.try_element_at(F.filter(F.col(name), lambda s: s["source"] == source), F.lit(1))["items"]
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))

    def said(source: Column) -> Column:
        note = only(own("discussion", source))
        entries = F.transform(values(own("entry", source)), lambda v: F.try_variant_get(v, "$", _ENTRY))
        tracked = bugs(own("bug", source))
        kind = F.coalesce(_text(note, "$.type"), F.when(entries.isNotNull(), F.lit("scraped_records")), F.lit("bugzilla"))
        return F.struct(kind.alias("type"), empty(F.try_variant_get(note, "$.value", "array<string>"), "string").alias("value"), empty(entries, _ENTRY).alias("entries"), empty(tracked, _BUG).alias("bugs"))

    return [
        by_source("description", lambda i: _text(only(i), "$.v")).alias("description"),
        F.flatten(F.transform(sources("cwe"), lambda s: F.transform(values(s["items"]), lambda v: F.try_variant_get(v, "$", _WEAKNESS)))).alias("cwe"),
        F.map_from_entries(F.transform(talk, lambda s: F.struct(s, said(s)))).alias("developer_discussion"),
        by_source("cvss", only).alias("cvss"),
        F.map_from_entries(F.flatten(F.transform(sources("cpe"), lambda s: F.transform(_ordered(s["items"], "item"), lambda i: F.struct(i["item"], F.try_variant_get(i["subs"][0]["value"], "$", "struct<cpe:string,version:string,vendor:string,product:string,product_version:string>")))))).alias("cpe"),
        by_source("exploit", keyed).alias("exploit_set"),
        by_source("patch", keyed).alias("patch_set"),
        F.coalesce(F.try_element_at(F.map_values(by_source("location", keyed)), F.lit(1)), F.create_map().cast("map<string,variant>")).alias("location"),
    ]


def reference_texts(item: Column) -> Column:
    """References of an item as texts: a plain one as it is, of an object its url, else its label, else its JSON."""
    refs = F.coalesce(F.try_variant_get(item, "$.references", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(refs, lambda r: F.coalesce(F.nullif(_text(r, "$.url"), F.lit("")), F.nullif(_text(r, "$.label"), F.lit("")), _text(r)))


def item_text(item: Column) -> Column:
    return tx.fields_as_text([(f, _text(item, f"$.{f}")) for f in TEXT_FIELDS], reference_texts(item))


def item_diff(item: Column) -> Column:
    """A usable diff of an item, or ''."""
    files = F.coalesce(F.try_variant_get(item, "$.files", "array<variant>"), F.try_variant_get(item, "$.changed_files", "array<variant>"), F.array().cast("array<variant>"))
    typed = F.transform(files, lambda f: F.struct(_text(f, "$.path").alias("path"), _text(f, "$.patch").alias("patch")))
    patch = F.coalesce(_text(item, "$.patch_text"), F.lit(""))
    return code.usable_diff(patch, tx.html_challenge(patch), typed)


def _doc(source: Column, text: Column) -> Column:
    return F.struct(source.alias("source"), text.alias("text"))


def _filled(docs: Column) -> Column:
    return F.filter(docs, lambda d: F.length(d["text"]) > 0)


def _entries(c: Column, use) -> Column:
    """use(key, value) of each of a map's entries."""
    return F.transform(F.map_entries(c), lambda e: use(e["key"], e["value"]))


def link_documents(items: Column, label: str, diff_tag: str) -> Column:
    """Of every item of a set one document, and one of its diff if it has one."""

    def one(source: Column, url: Column, item: Column) -> Column:
        head, own, diff = F.concat(F.lit(f"[{label} from "), source, F.lit("] "), url), item_text(item), item_diff(item)
        text = F.concat(head, F.when(F.length(own) > 0, F.concat(F.lit("\n"), own)).otherwise(""))
        return F.array(_doc(F.concat(F.lit(label.lower() + ":"), source), text), _doc(F.concat(F.lit(diff_tag + ":"), source), F.when(F.length(diff) > 0, F.concat(F.lit(f"[{diff_tag.upper()}]\n"), diff))))

    return _filled(F.flatten(F.flatten(_entries(items, lambda source, own: _entries(own, lambda url, item: one(source, url, item))))))


def discussion_documents(discussions: Column) -> Column:
    """Thanks as one document, notes as one each, records and comments one each."""

    def one(source: Column, d: Column) -> Column:
        thanks = _doc(source, F.concat(F.lit("Acknowledgements: "), F.array_join(d["value"], ", ")))
        notes = F.when(d["type"] == "acknowledgements", F.array(thanks)).otherwise(F.transform(d["value"], lambda v: _doc(source, v)))
        records = F.transform(d["entries"], lambda e: _doc(F.concat(source, F.lit(":"), F.coalesce(e["type"], F.lit("record"))), F.array_join(F.filter(F.array(*[F.when(F.length(e[f]) > 0, F.concat(F.lit(f"{f}: "), e[f])) for f in ENTRY_FIELDS]), lambda x: x.isNotNull()), "\n")))
        comments = F.flatten(F.transform(d["bugs"], lambda b: F.transform(b["comments"], lambda c: _doc(source, c["content"]))))
        return F.concat(notes, records, comments)

    return _filled(F.flatten(_entries(discussions, one)))


def code_blocks(location: Column) -> Column:
    """Texts of the tag `Vulnerable code block`, which may be a text, a list (of texts, lists or objects of texts) or an object of texts."""
    block = F.try_element_at(location, F.lit("Vulnerable code block"))
    texts = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.map_values(F.try_variant_get(v, "$", "map<string,string>")), F.array(_text(v)))
    return F.when(block.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.flatten(F.transform(F.try_variant_get(block, "$", "array<variant>"), texts)), texts(block)))


def _advisory_sections() -> list[Column]:
    """Sections in the order of the builder for vendors' portfolios."""
    return [
        _filled(_entries(F.col("description"), lambda s, t: _doc(F.concat(F.lit("description:"), s), t))),
        link_documents(F.col("patch_set"), "PATCH", "patch diff"),
        link_documents(F.col("exploit_set"), "EXPLOIT", "exploit code"),
        _entries(F.col("cvss"), lambda s, m: _doc(F.concat(F.lit("cvss:"), s), F.concat(F.lit("CVSS ("), s, F.lit("): "), F.to_json(m)))),
        _filled(F.array(_doc(F.lit("cpe"), F.when(F.size("cpe") > 0, F.concat(F.lit("Affected CPEs:\n"), F.array_join(F.map_keys("cpe"), "\n")))))),
        discussion_documents(F.col("developer_discussion")),
    ]


def _kernel_sections() -> list[Column]:
    """Sections in the order of the builder for kernel portfolios: code, message, patch and diff are one document each."""
    items = lambda name: F.flatten(_entries(F.col(name), lambda s, own: F.map_values(own)))
    joined = lambda texts, sep: F.array_join(F.filter(texts, lambda t: F.length(t) > 0), sep)
    whole = lambda source, head, text: _filled(F.array(_doc(F.lit(source), F.when(F.length(text) > 0, F.concat(F.lit(head), text)))))
    diffs = F.transform(items("patch_set"), item_diff)
    return [
        _filled(_entries(F.col("description"), _doc)),
        whole("Vulnerable code", "VULNERABLE CODE BLOCK: \n\n\n", joined(code_blocks(F.col("location")), "\n\n")),
        whole("patch message", "[PATCH MESSAGE] \n\n", joined(F.transform(items("patch_set"), lambda i: _text(i, "$.message")), "\n")),
        whole("patch code", " [PATCH CODE] \n", joined(F.transform(diffs, code.added_lines), "\n\n")),
        whole("code diff", " [CODE DIFF] +\n", joined(diffs, "\n\n")),
        whole("exploit code", " [EXPLOIT CODE] \n", joined(F.transform(F.filter(F.transform(items("exploit_set"), lambda i: F.coalesce(_text(i, "$.content"), item_diff(i))), lambda t: F.length(t) > 0), lambda t: F.concat(t, F.lit("\n\n"))), "")),
        _entries(F.col("cvss"), lambda s, m: _doc(F.lit("impact scores"), F.to_json(m))),
        discussion_documents(F.col("developer_discussion")),
    ]


#: Section catalogues: which documents a portfolio gives, in which order.
CATALOGUES = {"advisory": _advisory_sections, "kernel": _kernel_sections}


def documents(portfolios: DataFrame, catalogue: str = "advisory") -> DataFrame:
    """(cve, part, pos, source, text): the documents of portfolios; narrow, one pass over each row."""
    docs = F.concat(*[F.coalesce(c, F.array().cast("array<struct<source:string,text:string>>")) for c in CATALOGUES[catalogue]()])
    return portfolios.select("cve", "part", F.posexplode(docs).alias("pos", "d")).select("cve", "part", "pos", "d.source", "d.text")


#: Versions of a metric from the newest on, and the tags that are asked of it.
METRIC_VERSIONS = ["cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]
SCORE_TAGS = {"baseScore": ["cvssData.baseScore"], "baseSeverity": ["cvssData.baseSeverity", "baseSeverity"], "impactScore": ["impactScore"], "exploitabilityScore": ["exploitabilityScore"], "availabilityImpact": ["cvssData.availabilityImpact"]}
#: Fixed value: what stands for an answer that a portfolio doesn't hold.
NOT_GIVEN = "Not Given"


def ground_truth(portfolios: DataFrame, spine: str = "nvd") -> DataFrame:
    """(cve, category, attribute, truth): what portfolios know of each attribute that is asked for; attributes without a value have no row."""
    metrics = F.try_element_at("cvss", F.lit(spine))
    first = [F.coalesce(F.try_variant_get(metrics, f"$.{v}[0]", "variant"), F.try_variant_get(metrics, f"$.{v}", "variant")) for v in METRIC_VERSIONS]
    has = [F.coalesce(F.size(F.try_variant_get(metrics, f"$.{v}", "array<variant>")) > 0, F.try_variant_get(metrics, f"$.{v}", "map<string,variant>").isNotNull()) for v in METRIC_VERSIONS]
    newest = F.coalesce(*[F.when(h, m) for h, m in zip(has, first, strict=True)])
    items = lambda name: F.flatten(_entries(F.col(name), lambda s, own: F.map_values(own)))
    joined = lambda texts: F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n\n")
    row = lambda category, attribute, truth: F.struct(F.lit(category).alias("category"), attribute.alias("attribute"), truth.alias("truth"))
    p = portfolios.select("cve", F.transform(items("patch_set"), item_diff).alias("diffs"), F.transform(items("exploit_set"), lambda i: F.coalesce(_text(i, "$.content"), item_diff(i))).alias("codes"), newest.alias("metric"), "cwe", "location")
    rows = F.concat(
        F.transform(F.map_entries(F.col("location")), lambda e: row("Localization", e["key"], _text(e["value"]))),
        F.array(row("CWE", F.lit("CWE_ID"), F.nullif(cwe_values(F.col("cwe")), F.lit("Not given")))),
        F.array(*[row("SCORES", F.lit(tag), F.coalesce(*[_text(F.col("metric"), f"$.{path}") for path in paths])) for tag, paths in SCORE_TAGS.items()]),
        F.array(row("Patch", F.lit("Patch code"), joined(F.transform("diffs", code.added_lines))), row("Patch", F.lit("Code diff"), joined(F.col("diffs"))), row("Exploit", F.lit("Exploit Code"), joined(F.col("codes")))),
    )
    return p.select("cve", F.explode(F.filter(rows, lambda r: F.length(r["truth"]) > 0)).alias("r")).select("cve", "r.*")


def attach_truth(answers: DataFrame, portfolios: DataFrame) -> DataFrame:
    """answers of (cve, category, attribute) with `truth`, the sentinel where the portfolio gives none."""
    return answers.join(ground_truth(portfolios), ["cve", "category", "attribute"], "left").withColumn("truth", F.coalesce("truth", F.lit(NOT_GIVEN)))
