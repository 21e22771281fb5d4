"""Column builders for text: white space, filters, commit messages, names, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.functions.links import once
from vulnlake.functions.patterns import literal_index, matched, required_literals

#: White space as Unicode has it, and the four separators that regex classes leave out.
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Ends of lines.
RARE_END = "[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: What a kernel-related mail may say.
KERNEL_KEYWORDS = [
    "Linux kernel vulnerability",
    "Linux kernel CVE",
    "Linux kernel security issue",
    "Linux kernel exploit",
    "Linux kernel patch",
    "Linux kernel privilege escalation",
    "Linux kernel remote code execution",
    "Linux kernel syscall vulnerability",
    "Linux kernel buffer overflow",
    "Linux kernel memory corruption",
    "Linux kernel heap overflow",
    "Linux kernel race condition",
    "Linux kernel null pointer dereference",
    "Linux kernel use-after-free",
    "Linux kernel double free",
    "Linux kernel info leak",
    "Linux kernel integer overflow",
    "Linux kernel arbitrary code execution",
    "Linux kernel RCE",
    "Linux kernel DoS",
    "Linux kernel local privilege escalation",
    "Linux kernel denial of service",
    "site:seclists.org linux kernel CVE",
    "site:seclists.org linux kernel vulnerability",
    "site:seclists.org linux kernel security",
    "site:seclists.org linux kernel exploit",
    "site:seclists.org linux kernel patch",
    "site:seclists.org/oss-sec Linux kernel CVE",
    "site:seclists.org/bugtraq Linux kernel CVE",
    "site:seclists.org/full-disclosure Linux kernel CVE",
    "Linux kernel CVE RedHat",
    "Linux kernel CVE Debian",
    "Linux kernel CVE Ubuntu",
    "Linux kernel CVE SUSE",
    "Linux kernel CVE exploit-db",
    "Linux kernel CVE MITRE",
]
#: Patterns that may also mark one.
KERNEL_PATTERNS = [
    r"CVE-\d{4}-\d+.*(Linux|kernel)",
    r"Linux.*CVE",
    r"CVE.*Linux",
    r"Linux.*syscall.*CVE",
    r"CVE.*syscall.*Linux",
    r"CVE.*kernel",
]
#: Commit-message lines that begin so are metadata; and what stands for a message of nothing else.
METADATA_PREFIXES = [
    "Signed-off-by:",
    "Acked-by:",
    "Reviewed-by:",
    "Tested-by:",
    "Reported-by:",
    "Cc:",
    "Fixes:",
    "Link:",
    "Co-authored-by:",
    "Suggested-by:",
    "Relnotes:",
    "Change-Id:",
    "cherry picked from commit",
]
ONLY_METADATA = "[Message content removed as it only contained metadata]"
#: Patterns of file and function names in a description, and words that are no function.
FILE_NAME = r"(?i)(?:\bfile\s+|\bin\s+|\bof\s+)?([A-Za-z0-9_\-./]+?/?[A-Za-z0-9_\-]+\.(?:c|h|s|S|cc|cpp|go|o))(?=[\s,;:.)]|$)"
UNDERSCORE_NAME = r"\b([A-Za-z0-9]*_[A-Za-z0-9_]*[a-z][A-Za-z0-9_]*)\b(?!\s*\.(?:c|h|s|S|cc|cpp|go|o)\b)"
NAME_TOKEN = "[A-Za-z0-9_]*[a-z][A-Za-z0-9_]*"
NOT_FUNCTIONS = ["in", "of", "fix", "handle", "add", "remove", "enable", "disable", "return", "error", "leak", "update", "use", "make", "move", "change"]
#: What may follow a name that is a file, and where a name is said to be a function.
NO_FILE = r"(?!\s*\.(?:c|h|s|S|cc|cpp|go|o)\b)"
SAID_FUNCTION = rf"(?:\b({NAME_TOKEN})\s*\(\)|\bfunction\s+({NAME_TOKEN})\b|\b({NAME_TOKEN})\s+function\b){NO_FILE}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def same_as_or_self(c: Column, other: Column, label: str = "same as nvd") -> Column:
    """The label where the two texts differ in white space only."""
    return F.when(without_space(c) == without_space(other), label).otherwise(c)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), strip(F.substring(c, len(prefix) + 1, 1 << 30))).otherwise(c)


def lines(c: Column) -> Column:
    """Lines of a text; an end of line at the very end begins no further line."""
    parts = F.when(c.rlike(RARE_END), F.split(c, LINE_END)).otherwise(F.split(c, "\n"))  # a split at one character is much cheaper
    return once(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def clean_commit_message(c: Column) -> Column:
    def stays(line):
        own = strip(line)
        meta = F.lit(False)
        for p in METADATA_PREFIXES:
            meta = meta | own.startswith(p)
        return ~meta & ~own.rlike(r"(?i)^commit\s+[0-9a-f]{40}$")

    return F.coalesce(F.nullif(strip(F.array_join(F.filter(lines(c), stays), "\n")), F.lit("")), F.lit(ONLY_METADATA))


def matched_keywords(c: Column, keywords: list[str]) -> Column:
    low, index = F.lower(c), literal_index({k: [k.lower()] for k in keywords})
    return matched(low, index, lambda k: F.contains(low, F.lit(k.lower())), keywords)


def matched_patterns(c: Column, patterns: list[str]) -> Column:
    return matched(F.lower(c), literal_index({p: required_literals(p) for p in patterns}), lambda p: c.rlike(f"(?i){p}"), patterns)


def score_and_severity(c: Column) -> tuple[Column, Column]:
    """Parts of `7.8 · High`."""
    parts = F.split(c, "·")
    return strip(F.try_element_at(parts, F.lit(1))), strip(F.try_element_at(parts, F.lit(2)))


def cve_in(c: Column, default: str | None = None) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"CVE-\d{4}-\d{4,7}", 0), F.lit("")), F.lit(default))


def cves_in(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\bCVE-\d{4}-\d{4,7}\b"), 0)))


def file_candidates(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(FILE_NAME), 1)))


def function_candidates(c: Column) -> Column:
    found = F.array_union(F.regexp_extract_all(c, F.lit(UNDERSCORE_NAME), 1), F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(SAID_FUNCTION), i) for i in (1, 2, 3)])))
    return F.array_sort(F.filter(found, lambda f: (F.length(f) > 2) & ~F.lower(f).isin(NOT_FUNCTIONS)))


def safe_filename(c: Column, most: int = 160) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}\-_.()]", "_"), 1, most), F.lit("")), F.lit("unnamed"))


def person_and_date(c: Column) -> tuple[Column, Column, Column]:
    """Parts of `Name <email> date`."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^\s*(.*?)\s*<([^>]*)>\s*(.*?)\s*$", i), F.lit(""))
    return part(1), part(2), part(3)


def html_challenge(c: Column) -> Column:
    """Whether a download is a page that wants a human."""
    head = F.lower(F.substring(c, 1, 300))
    return F.contains(head, F.lit("<!doctype html")) | F.contains(head, F.lit("not a bot")) | F.contains(head, F.lit("<html"))


def escape_markup(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def fill_template(template: Column, slots: dict[str, Column]) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def without_fences(c: Column) -> Column:
    """The inside of a fenced block of JSON."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def claim_list(raw: Column, response: Column) -> Column:
    """Claims as a JSON array of strings, fenced or not; unreadable ones are the whole response as one claim."""
    return F.coalesce(F.from_json(without_fences(raw), "array<string>"), F.array(response))


def score_map(raw: Column) -> Column:
    """A judge's JSON object, fenced or not, its values as text; an unreadable one is an empty map."""
    return F.coalesce(F.from_json(without_fences(raw), "map<string,string>"), F.create_map().cast("map<string,string>"))


def fields_as_text(fields: list[tuple[str, Column]], references: Column) -> Column:
    """`name: value` lines of the fields that have a value, then the references."""
    parts = [F.when(F.length(v) > 0, F.concat(F.lit(f"{name}: "), v)) for name, v in fields]
    refs = F.array_join(F.filter(references, lambda r: F.length(r) > 0), ", ")
    return F.concat_ws("\n", *parts, F.when(F.length(refs) > 0, F.concat(F.lit("references: "), refs)))


def first_filled(*candidates: Column) -> Column:
    """The first of some texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def hash_vector(c: Column) -> Column:
    """Sixteen numbers from 0 to 1: the bytes of a text's MD5."""
    digest = F.md5(c.cast("binary"))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)
