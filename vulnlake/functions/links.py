"""Column builders for links: hosts, kinds, commit hashes, derived addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.functions.patterns import required_literals, where_literal

#: Addresses of the kernel's repositories.
KERNEL_GIT = [
    r"""https?://git\.kernel\.org/[^\s'"<>]+""",
    r"""https?://github\.com/torvalds/linux/[^\s'"<>]+""",
    r"""https?://git\.kernel\.org/pub/scm/linux/kernel/git/[^\s'"<>]+""",
    r"""https?://cgit\.kernel\.org/[^\s'"<>]+""",
    r"""https?://git\.kernel\.org/cgit/[^\s'"<>]+""",
]
#: Where an address may hold a commit hash.
COMMIT_HASH = [
    r"github\.com/torvalds/linux/commit/([a-f0-9]{7,40})",
    r"[?&]id=([a-f0-9]{7,40})",
    r"%3Bh=([a-f0-9]{7,40})",
    r";h=([a-f0-9]{7,40})",
    r"git\.kernel\.org/linus/([a-f0-9]{7,40})",
    r"git\.kernel\.org/stable/c/([a-f0-9]{7,40})",
    r"commit/\?id=([a-f0-9]{7,40})",
    r"/([a-f0-9]{40})(?:[/?&#]|$)",
    r"/([a-f0-9]{7,12})(?:[/?&#]|$)",
]
#: Buckets of a repository link, the first that fits counts.
GIT_BUCKETS = ["git.kernel.org", "github.com/torvalds/linux", "cgit.kernel.org", "lore.kernel.org", "patchwork.kernel.org"]


def once(c: Column, use) -> Column:
    """use(c) with c computed once, however often it is used."""
    return F.transform(F.array(c), use)[0]


def domain(url: Column) -> Column:
    """Authority in lower case without `www.`; port and user stay; empty without a scheme."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def decoded(url: Column) -> Column:
    """Percent signs decoded, plus signs kept; an address with a bad escape stays as it is."""
    return F.when(F.contains(url, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)).otherwise(url)


def is_kernel_git(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(KERNEL_GIT))


def commit_hashes(url: Column) -> Column:
    """Sorted distinct hashes, in lower case.

    Addresses without seven digits of a hash in a row have none; of the others each runs only the patterns whose literal it holds.
    """
    none = F.array().cast("array<string>")

    def found(u: Column) -> Column:
        hits = [where_literal(u, max(required_literals(p), key=len), F.regexp_extract_all(u, F.lit(p), F.lit(1)), none) for p in COMMIT_HASH]
        return F.array_sort(F.array_distinct(F.concat(*hits)))

    return once(F.lower(decoded(url)), lambda u: F.when(u.rlike("[a-f0-9]{7}"), found(u)).otherwise(none))


def git_bucket(url: Column) -> Column:
    out = F.when(F.contains(url, F.lit(GIT_BUCKETS[0])), GIT_BUCKETS[0])
    for b in GIT_BUCKETS[1:]:
        out = out.when(F.contains(url, F.lit(b)), b)
    return out.otherwise("other")


def number_in(url: Column, before: str) -> Column:
    """Digits after a path such as `/files/`."""
    return F.nullif(F.regexp_extract(url, before + r"(\d+)", 1), F.lit(""))


def repository_item(url: Column) -> Column:
    """struct(kind, owner, repo, id) of a repository host's address; null if it names no repository."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return once(F.filter(F.split(path, "/"), lambda p: p != ""), _item_of)


def _item_of(parts: Column) -> Column:
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rest = lambda i: F.array_join(F.slice(parts, i, F.greatest(n - i + 1, F.lit(0))), "/")
    section = at(3)
    cases = [
        (n == 2, "repo", F.lit(None).cast("string")),
        ((section == "commit") & (n >= 4), "commit", at(4)),
        ((section == "pull") & (n >= 4), "pull", at(4)),
        ((section == "issues") & (n >= 4), "issue", at(4)),
        ((section == "security") & (n >= 5) & (at(4) == "advisories"), "advisory", at(5)),
        ((section == "releases") & (n >= 5) & (at(4) == "tag"), "release", rest(5)),
        ((section == "blob") & (n >= 5), "blob", rest(4)),
        ((section == "compare") & (n >= 4), "compare", rest(4)),
        (F.lit(True), "other", rest(3)),
    ]
    found = None
    for test, name, value in cases:
        own = F.struct(F.lit(name).alias("kind"), value.alias("id"))
        found = F.when(test, own) if found is None else found.when(test, own)
    repo = F.regexp_replace(at(2), r"\.git$", "")
    return F.when(n >= 2, once(found, lambda f: F.struct(f["kind"].alias("kind"), at(1).alias("owner"), repo.alias("repo"), f["id"].alias("id"))))


def api_address(item: Column) -> Column:
    """Where the item's record is served; null for kinds without one."""
    paths = {"commit": "/commits/", "pull": "/pulls/", "issue": "/issues/", "advisory": "/security-advisories/", "release": "/releases/tags/", "compare": "/compare/"}
    tail = F.when(item["kind"] == "repo", F.lit(""))
    for kind, path in paths.items():
        tail = tail.when(item["kind"] == kind, F.concat(F.lit(path), item["id"]))
    return F.concat(F.lit("https://api.github.com/repos/"), item["owner"], F.lit("/"), item["repo"], tail)


def patch_address(item: Column) -> Column:
    return F.when(item["kind"] == "commit", F.concat(F.lit("https://github.com/"), item["owner"], F.lit("/"), item["repo"], F.lit("/commit/"), item["id"], F.lit(".patch")))


def cgit_patch_address(url: Column) -> Column:
    """A commit page's raw patch."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    sep = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(F.contains(path, F.lit("/c/")), F.concat(url, sep, F.lit("patch=1"))).when(F.contains(path, F.lit("/commit")), F.replace(url, F.lit("/commit"), F.lit("/patch"))).otherwise(url)


def file_extension(url: Column, default: str = ".bin") -> Column:
    """Extension of a download by its last path segment."""
    last = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(last, r"(\.[A-Za-z0-9]+)$", 1), F.lit("")), F.lit(default))


def matching_links(urls: Column, host: str) -> Column:
    return F.filter(F.array_distinct(urls), lambda u: F.contains(u, F.lit(host)))
