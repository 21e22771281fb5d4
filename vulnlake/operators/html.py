"""Extraction from pages: a small element tree on the standard parser, and one extractor a source.

Pages come with unclosed tags, so the parser closes what a page leaves open.  The generic extractors (title, heading,
links, elements by tag and attribute) and the sources' extractors run as Arrow-batched maps; each gives one row a page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, and those that a new one of the same group ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "section", "h1", "h2", "h3", "h4", "pre"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
HIDDEN = {"script", "style"}


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Element | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self):
        """Elements below this one, in document order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(k for k in reversed(e.kids) if isinstance(k, Element))

    def strings(self):
        stack = list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                yield k
            elif k.tag not in HIDDEN:
                stack.extend(reversed(k.kids))

    def text(self, sep: str = "", strip: bool = True) -> str:
        parts = [s.strip() if strip else s for s in self.strings()]
        return sep.join(p for p in parts if p) if strip else "".join(parts)

    def fits(self, tag: str | None, attrs: dict[str, str | None]) -> bool:
        if tag and self.tag != tag:
            return False
        for k, v in attrs.items():
            own = self.attrs.get(k, "") if k in self.attrs else None
            if own is None or (v is not None and (v not in (own or "").split() if k == "class" else own != v)):
                return False
        return True

    def all(self, tag: str | None = None, **attrs: str | None) -> list[Element]:
        attrs = {k.rstrip("_").replace("__", "-"): v for k, v in attrs.items()}
        return [e for e in self.walk() if e.fits(tag, attrs)]

    def first(self, tag: str | None = None, **attrs: str | None) -> Element | None:
        return next(iter(self.all(tag, **attrs)), None)

    def holding(self, tags: set[str], words: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags and words.lower() in e.text(" ").lower()), None)

    def after(self) -> list:
        """What follows this element under its parent."""
        own = self.parent.kids if self.parent else []
        return own[next(i for i, k in enumerate(own) if k is self) + 1 :]

    def next_element(self) -> Element | None:
        return next((k for k in self.after() if isinstance(k, Element)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.parent and tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        e = Element(tag, dict(attrs), self.at)
        self.at.kids.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Element(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e.parent and e.tag != tag:
            e = e.parent
        if e.parent:
            self.at = e.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _text(e: Element | None, sep: str = " ") -> str | None:
    return e.text(sep) or None if e is not None else None


def _cells(table: Element | None) -> list[list[str]]:
    return [[c.text(" ") for c in row.walk() if c.tag in ("td", "th")] for row in (table.all("tr") if table else [])]


def redhat(page: Element) -> dict:
    """H1: a vendor's page of one CVE."""
    body = lambda name: _text(next((d for s in page.all("section", id=f"cve-details-{name}") for d in s.all("div") if "pfe-markdown-render" in d.attrs), None), "\n")
    info = page.first(id="additional-info")
    scores = page.first("section", id="cve-cvss")
    columns: dict[str, dict[str, str]] = {"Red Hat": {}, "NVD": {}}
    for row in _cells(scores.first("table", id="cvss-table") if scores else None):
        if len(row) == 3:
            columns["Red Hat"][row[0]], columns["NVD"][row[0]] = row[1], row[2]
    for key, name in (("Red Hat", "rh-vector"), ("NVD", "nvd-vector")):
        vector = _text(scores.first("span", data__test=name)) if scores else None
        if vector:
            columns[key]["vector"] = vector
    card = lambda name, cls: _text(c.first("span", class_=cls)) if (c := page.first("div", id=f"stat-card-{name}")) else None
    links = [a.attrs["href"] or "" for a in (info.all("a", href=None) if info else [])]
    return {
        "title": _text(page.first("h1")),
        "description": body("description"),
        "statement": body("statement"),
        "mitigation": body("mitigation"),
        "additional_info": [li.text() for ul in (info.all("ul", id="additional-info-list") if info else []) for li in ul.all("li")],
        "bugzilla_ids": [m[1] for x in links if (m := re.search(r"bugzilla\.redhat\.com/(?:show_bug\.cgi\?id=)?(\d+)", x))],
        "cvss": columns,
        "impact": card("impact", "severity-text"),
        "cvss_score": card("score", "stat-number"),
    }


def bugzilla(page: Element) -> dict:
    """H2: a bug and its comments."""
    span = lambda name: _text(page.first("span", id=name))
    comments = []
    for div in page.all("div", class_="bz_comment"):
        part = lambda tag, cls, div=div: _text(div.first(tag, class_=cls))
        comments.append({"comment_id": div.attrs.get("id"), "comment_number": part("span", "bz_comment_number"), "user": part("span", "bz_comment_user"), "time": part("span", "bz_comment_time"), "text": part("pre", "bz_comment_text"), "is_first": "bz_first_comment" in (div.attrs.get("class") or "").split()})
    severity = next((a for a in page.all("a", href=None) if "fields.html#bug_severity" in (a.attrs["href"] or "")), None)
    line = severity.parent.parent if severity is not None and severity.parent is not None else None
    value = next((e.text(" ") for e in (line.all("td") if line else [])), None)
    return {"summary": span("short_desc_nonedit_display"), "status": span("static_bug_status"), "alias": span("alias_nonedit_display"), "severity": value, "comments": comments}


def ubuntu(page: Element) -> dict:
    """H3: a distribution's page of one CVE."""
    label = page.holding({"p"}, "Ubuntu priority")
    beside = label.next_element() if label is not None else None
    priority = _text(beside.first("strong")) if beside is not None else None
    if priority is None:
        title = page.first(class_="p-heading-icon__title")
        priority = _text(title.first("strong")) if title is not None else None
    scored = page.holding({"h2", "p"}, "Cvss 3 Severity Score")
    beside = scored.next_element() if scored is not None else None
    score, _, severity = (beside.text(" ") if beside is not None else "").partition("·")
    box = page.first(id="description")
    notes = page.holding({"h2", "h3"}, "From the Ubuntu Security Team")
    note = notes.next_element() if notes is not None else None
    return {"cve_id": _text(page.first("h1")), "priority": priority, "score": score.strip() or None, "severity": severity.strip() or None, "description": next((k.text(" ") for k in (box.kids if box else []) if isinstance(k, Element) and k.tag == "p"), None), "notes": _text(note)}


def packet_storm(page: Element) -> dict:
    """H4: a file's page in an archive."""
    title = page.first("div", class_="fretrot") or page.first("div", class_="fretromob")
    cell = title.first("td") if title is not None else None
    cves = []
    for row in page.all("tr"):
        cells = row.all("td")
        if len(cells) >= 2 and "CVE" in cells[0].text():
            cves += [a.text() for a in cells[1].all("a")]
    head = page.holding({"div"}, "Description")
    beside = head.next_element() if head is not None else None
    return {"title": _text(cell or title), "cves": cves, "description": _text(beside), "content": _text(page.first("pre", class_="contentbox"), "\n")}


def exploit_db(page: Element) -> dict:
    """H5: an exploit's page: label and value pairs, CVE, whether it is verified, the affected program's link."""
    labels, values = [e.text(" ").rstrip(":") for e in page.all("h4", class_="info-title")], [e.text(" ") for e in page.all("h6", class_="stats-title")]
    fields = dict(zip(labels, values, strict=False))
    verified, app = False, None
    for div in page.all("div", class_="stats"):
        name = _text(div.first("strong")) or ""
        icon, link = div.first("i"), div.first("a", href=None)
        if "Verified" in name and icon is not None:
            verified = "mdi-check" in (icon.attrs.get("class") or "").split()
        if "Vulnerable App" in name and link is not None:
            app = link.attrs["href"]
    return {"title": _text(page.first("h1", class_="card-title")), "fields": fields, "cve": fields.get("CVE"), "verified": verified, "app": app}


def lwn_alerts(page: Element) -> dict:
    """H6: rows of an alert table, its header left out."""
    rows = []
    for row in page.all("tr")[1:]:
        cells = row.all("td")
        link = cells[0].first("a", href=None) if cells else None
        if len(cells) >= 3:
            rows.append({"id": cells[0].text(), "url": link.attrs["href"] if link is not None else "N/A", "package": cells[-2].text(), "date": cells[-1].text()})
    return {"rows": rows}


def lwn_article(page: Element) -> dict:
    """H6: an article's head (rows of three cells) and text."""
    meta = {cells[0].rstrip(":"): cells[2] for cells in _cells(page) if len(cells) == 3}
    link = next((a.attrs["href"] for a in page.all("a", href=None) if "errata." in (a.attrs["href"] or "")), "N/A")
    return {"title": _text(page.first("h1")) or "Title not found", "meta": meta, "advisory": link, "content": _text(page.first("div", class_="ArticleText"), "\n")}


def mail_threads(page: Element) -> dict:
    """H7: messages of a thread list between two rules, as rows with parent and depth."""
    rows: list[dict] = []

    def visit(li: Element, parent: str | None, depth: int) -> None:
        a = li.first("a", href=None)
        number = str(len(rows))
        rows.append({"id": number, "parent": parent, "depth": depth, "href": a.attrs["href"] if a is not None else None, "title": _text(a), "author_date": _text(li.first("em"))})
        nested = li.first("ul")
        for kid in nested.kids if nested is not None else []:
            if isinstance(kid, Element) and kid.tag == "li":
                visit(kid, number, depth + 1)

    top = page.first(class_="thread")
    for li in top.kids if top is not None else []:
        if isinstance(li, Element) and li.tag == "li":
            visit(li, None, 0)
    return {"messages": rows}


def mail_message(page: Element) -> dict:
    """H7: one message."""

    def after(label: str) -> str | None:
        e = next((e for e in page.all("em") if e.text() == label), None)
        return next((k.strip(" :\n") for k in e.after() if isinstance(k, str)), None) if e is not None else None

    title = _text(page.first("h1", class_="m-title"))
    found = re.search(r"CVE-\d{4}-\d{4,7}", title or "")
    return {"title": title, "cve": found[0] if found else None, "from": after("From"), "date": after("Date"), "body": _text(page.first("pre"), "\n")}


#: Headings of a bulletin's sections, each under any of its labels.
BULLETIN_SECTIONS = {
    "summary": ["Summary"],
    "vulnerability_details": ["Vulnerability Details", "Vulnerability details"],
    "affected_products": ["Affected Products and Versions", "Affected Products", "Affected products"],
    "remediation": ["Remediation/Fixes", "Remediation / Fixes", "Remediation", "Fixes"],
    "workarounds": ["Workarounds and Mitigations", "Workarounds"],
    "references": ["References"],
}


def section(page: Element, labels: list[str]) -> str | None:
    """Text from a heading up to the next one, for the first label whose section says something."""
    for label in labels:
        heading = page.holding({"h2", "h3", "h4", "strong", "b"}, label)
        parts = []
        for k in heading.after() if heading is not None else []:
            if isinstance(k, Element) and k.tag in ("h2", "h3", "h4"):
                break
            parts.append(k.text("\n") if isinstance(k, Element) else k.strip())
        if text := "\n".join(p for p in parts if p):
            return text
    return None


def bulletin(page: Element) -> dict:
    """H8: sections between headings, links in the references, CVE ids; a page without them falls back on its JSON-LD."""
    out: dict = {name: section(page, labels) for name, labels in BULLETIN_SECTIONS.items()}
    out["references"] = re.findall(r"https?://\S+", out["references"] or "")
    out["title"] = _text(page.first("h1")) or _text(page.first("title"))
    out["cves"] = sorted(set(re.findall(r"\bCVE-\d{4}-\d{4,7}\b", page.text(" "))))
    if not out["summary"]:
        for script in page.all("script", type="application/ld+json"):
            try:
                found = json.loads("".join(k for k in script.kids if isinstance(k, str)))
            except ValueError:
                continue
            if isinstance(found, dict):
                out["summary"] = found.get("description")
                out["title"] = out["title"] or found.get("headline")
    return out


def cgit_commit(page: Element) -> dict:
    """H9: a commit's page."""
    row = lambda label: next((_text(th.next_element()) for th in page.all("th") if th.text().lower().startswith(label)), None)
    author = re.match(r"^(.*?)\s*<([^>]+)>\s*(.*)$", row("author") or "")
    subject, body = page.first("div", class_="commit-subject"), page.first("div", class_="commit-msg")
    return {
        "author": author[1].strip() if author else row("author"),
        "author_email": author[2].strip() if author else None,
        "date": author[3].strip() if author else None,
        "committer": row("committer"),
        "subject": _text(subject or body),
        "message": body.text(strip=False) if body is not None else "",
        "changed_files": [a.text() for t in page.all("table", class_="diffstat") for a in t.all("a") if a.text()],
    }


def outline(page: Element) -> dict:
    """Title, first heading and links of any page."""
    return {"title": _text(page.first("title")), "h1": _text(page.first("h1")), "links": [{"href": a.attrs["href"], "text": a.text(" ")} for a in page.all("a", href=None)]}


EXTRACTORS: dict[str, Callable[[Element], dict]] = {f.__name__: f for f in (redhat, bugzilla, ubuntu, packet_storm, exploit_db, lwn_alerts, lwn_article, mail_threads, mail_message, bulletin, cgit_commit, outline)}
#: Types of what the extractors return.
SCHEMAS = {
    "redhat": "struct<title string, description string, statement string, mitigation string, additional_info array<string>, bugzilla_ids array<string>, cvss map<string, map<string, string>>, impact string, cvss_score string>",
    "bugzilla": "struct<summary string, status string, alias string, severity string, comments array<struct<comment_id string, comment_number string, user string, time string, text string, is_first boolean>>>",
    "ubuntu": "struct<cve_id string, priority string, score string, severity string, description string, notes string>",
    "packet_storm": "struct<title string, cves array<string>, description string, content string>",
    "exploit_db": "struct<title string, fields map<string, string>, cve string, verified boolean, app string>",
    "lwn_alerts": "struct<rows array<struct<id string, url string, package string, date string>>>",
    "lwn_article": "struct<title string, meta map<string, string>, advisory string, content string>",
    "mail_threads": "struct<messages array<struct<id string, parent string, depth int, href string, title string, author_date string>>>",
    "mail_message": "struct<title string, cve string, `from` string, date string, body string>",
    "bulletin": "struct<summary string, vulnerability_details string, affected_products string, remediation string, workarounds string, references array<string>, title string, cves array<string>>",
    "cgit_commit": "struct<author string, author_email string, date string, committer string, subject string, message string, changed_files array<string>>",
    "outline": "struct<title string, h1 string, links array<struct<href string, text string>>>",
}


def extract(kind: str, html: Column) -> Column:
    """The page's record of one kind, as a struct.  Pages go through JSON, so a record's type is checked on the JVM's side."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        read = EXTRACTORS[kind]
        return pages.map(lambda html: json.dumps(read(parse(html)), ensure_ascii=False))

    return F.from_json(run(html), SCHEMAS[kind])


def first_pre(html: Column) -> Column:
    """Text of the first preformatted block, without a parser."""
    return F.nullif(F.regexp_extract(html, r"(?is)<pre[^>]*>(.*?)</pre>", 1), F.lit(""))


def without_missing(pages: DataFrame, id_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """pages with a first heading, and of these the ones whose heading does not name their id."""
    heading = F.regexp_extract(html_col, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    found = pages.where(F.col(html_col).rlike(r"(?i)<h1[\s>]"))
    return found, found.where(~F.contains(heading, F.col(id_col).cast("string")))
