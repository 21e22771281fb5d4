"""Column builders for diffs and C source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.functions.links import once
from vulnlake.functions.text import lines

#: C keywords that stand before a parenthesis or a name but are no function.
C_KEYWORDS = ["if", "for", "while", "switch", "sizeof", "return", "case", "else", "do", "break", "continue", "goto", "typedef", "struct", "union", "enum", "const", "static", "extern", "inline", "volatile"]
#: Fixed value: a name in front of a parenthesis, with what may stand before it.
FUNCTION_HEAD = r"(?:[\w\s*&]+\s+)?([a-zA-Z_]\w*(?:##[a-zA-Z_]\w*)?)\s*\("


def hunk_function(context: Column) -> Column:
    """Function that the context behind a hunk header names, or null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(context), r"/\*.*?\*/", ""), "//.*", ""))

    def named(head: Column, name: Column) -> Column:
        shouted = (name == F.upper(name)) & name.rlike("[A-Z]")
        ok = (name != "") & ~head.startswith("#define") & ~name.isin(C_KEYWORDS) & (~shouted | F.contains(name, F.lit("##")))
        return F.when(ok, name)

    return once(F.trim(F.split(bare, r"\{", 2)[0]), lambda head: once(F.regexp_extract(head, FUNCTION_HEAD, 1), lambda name: named(head, name)))


def added_lines(diff: Column) -> Column:
    """The `+` lines of a unified diff, without the sign."""
    own = F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(own, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def line_slice(source: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(source, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def tag_field(tag: Column, name: str) -> Column:
    """Number of a `name:` field in a row of tags."""
    found = F.try_element_at(F.filter(F.split(tag, "\t"), lambda x: x.startswith(f"{name}:")), F.lit(1))
    return F.try_element_at(F.split(found, ":"), F.lit(2)).try_cast("int")


def status_and_name(line: Column) -> tuple[Column, Column]:
    """Parts of `M\\tpath`; a renamed file has two paths, of which the last counts."""
    parts = F.split(line, "\t")
    return parts[0], F.element_at(parts, -1)


def log_blocks(log: Column) -> Column:
    """Entries of a log, each from its `commit` line up to the next one's."""
    return F.filter(F.split(log, r"(?m)^(?=commit [0-9a-f]{7,40}\b)"), lambda b: b.startswith("commit "))


def log_entry(block: Column) -> Column:
    """struct(hash, author, date, message, files) of one entry; files: struct(name, status), of a renamed file the new name."""
    return once(lines(block), _entry_of)


def _entry_of(rows: Column) -> Column:
    field = lambda p: F.trim(F.regexp_replace(F.try_element_at(F.filter(rows, lambda x: x.startswith(p)), F.lit(1)), f"^{p}", ""))
    message = F.array_join(F.transform(F.filter(rows, lambda x: x.startswith("    ")), lambda x: F.trim(x)), "\n")
    changed = F.filter(rows, lambda x: x.rlike("^[A-Z][0-9]*\t"))

    def file(x: Column) -> Column:
        status, name = status_and_name(x)
        return F.struct(name.alias("name"), status.alias("status"))

    hash_ = F.regexp_extract(F.try_element_at(rows, F.lit(1)), "^commit ([0-9a-f]+)", 1)
    return F.struct(hash_.alias("hash"), field("Author:").alias("author"), field("Date:").alias("date"), message.alias("message"), F.transform(changed, file).alias("files"))


def usable_diff(patch: Column, challenge: Column, files: Column) -> Column:
    """The patch where it is usable, else the files' patches one after the other."""
    whole = F.array_join(F.transform(F.filter(files, lambda f: F.length(f["patch"]) > 0), lambda f: F.concat(F.lit("--- "), F.coalesce(f["path"], F.lit("")), F.lit("\n"), f["patch"])), "\n\n")
    return F.when((F.length(patch) > 0) & ~challenge, patch).otherwise(whole)


#: What a piece of C source is made of up to its next brace: plain characters, comments, literals; a lone quote or slash is plain.
_PIECE = r"""(?s)(?:[^{}"'/]++|/\*.*?(?:\*/|\z)|//[^\n]*+|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|["'/])*+(?:[{}]|\z)"""


def balanced_lines(source: Column) -> Column:
    """The lines of C source up to the first whose end finds the braces balanced after one was opened, or null.

    Braces count in code alone: strings, characters and comments of both kinds are passed over as a scanner would, a line comment
    to its line's end, an unclosed block comment to the source's.  One pass: the source is cut into pieces that each end with a brace
    of the code, and a fold over them keeps depth and position.
    """
    pieces = F.regexp_extract_all(source, F.lit(_PIECE), F.lit(0))

    def step(s: Column, piece: Column) -> Column:
        last = F.right(piece, F.lit(1))
        # balanced before this piece, and the line ended before its brace
        done = s["done"].isNotNull() | (s["open"] & (s["depth"] == 0) & (F.contains(piece, F.lit("\n")) | ~last.isin("{", "}")))
        return F.struct((s["depth"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)).alias("depth"), (s["open"] | (last == "{")).alias("open"), (s["at"] + F.length(piece)).alias("at"), F.when(done, F.coalesce(s["done"], s["at"])).alias("done"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("done"))
    end = F.aggregate(pieces, start, step, lambda s: F.coalesce(s["done"], F.when(s["open"] & (s["depth"] == 0), s["at"])))
    return once(end, lambda n: F.when(n.isNotNull(), F.concat(F.left(source, n), F.regexp_extract(F.substr(source, n + 1), r"^[^\n]*", 0))))


def function_body(source: Column, start: Column) -> Column:
    """balanced_lines from a 1-based line on; null if there is no such line."""
    rows = F.split(source, "\n")
    return F.when((start > 0) & (start <= F.size(rows)), balanced_lines(F.array_join(F.slice(rows, start, F.size(rows)), "\n")))


def diff_path(line: Column) -> Column:
    """The new path that a `diff --git` line names; '' if it has too few parts, null for any other line."""
    path = F.try_element_at(F.split(line, " "), F.lit(4))
    return F.when(line.startswith("diff --git a/"), F.coalesce(F.regexp_replace(path, "^b/", ""), F.lit("")))


def named_functions(diff: Column) -> Column:
    """array of struct(file, function): what the hunks of a diff's C files name, and header and assembler files themselves; hunks without a file name none."""

    def of(block: Column, file: Column) -> Column:
        inside = F.filter(F.transform(F.filter(block, lambda x: x.startswith("@@ ")), lambda x: hunk_function(F.regexp_replace(x, "^@@.*?@@", ""))), lambda f: f.isNotNull())
        names = F.when(file.rlike(r"\.[hS]$"), F.array(file)).when(file.endswith(".c"), inside).otherwise(F.array().cast("array<string>"))
        return F.transform(names, lambda f: F.struct(file.alias("file"), f.alias("function")))

    def blocks(rows: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: F.get(rows, i - 1).startswith("diff --git a/"))
        block = lambda all_: F.transform(all_, lambda at, i: F.slice(rows, at, F.coalesce(F.get(all_, i + 1), F.size(rows) + 1) - at))
        return once(heads, lambda all_: F.flatten(F.transform(block(all_), lambda b: once(F.nullif(diff_path(b[0]), F.lit("")), lambda file: of(b, file)))))

    return once(lines(diff), blocks)


_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?([^\n]*)"


def _hunk(text: Column) -> Column:
    """struct(old_start, old_len, new_start, new_len, section, lines) of a hunk; lines beyond its counts are left out."""
    number = lambda i: F.regexp_extract(text, _HUNK, i).try_cast("int")
    length = lambda i: F.coalesce(number(i), F.lit(1))
    rows = lines(text)
    rows = F.slice(rows, 2, F.size(rows))

    def step(s: Column, row: Column) -> Column:
        old, new = ~F.substring(row, 1, 1).isin("+", "\\"), ~F.substring(row, 1, 1).isin("-", "\\")
        open_ = (s["old"] > 0) | (s["new"] > 0) | row.startswith("\\")
        more = s["go"] & open_
        return F.struct((s["old"] - F.when(more & old, 1).otherwise(0)).alias("old"), (s["new"] - F.when(more & new, 1).otherwise(0)).alias("new"), (s["n"] + F.when(more, 1).otherwise(0)).alias("n"), more.alias("go"))

    start = F.struct(length(2).alias("old"), length(4).alias("new"), F.lit(0).alias("n"), F.lit(True).alias("go"))
    kept = F.slice(rows, F.lit(1), F.aggregate(rows, start, step, lambda s: s["n"]))
    return F.struct(number(1).alias("old_start"), length(2).alias("old_len"), number(3).alias("new_start"), length(4).alias("new_len"), F.regexp_extract(text, _HUNK, 5).alias("section"), kept.alias("lines"))


def file_changes(diff: Column) -> Column:
    """The files of a unified diff: array of struct(old_path, new_path, status, hunks).

    status is A, D, R or M; a path is null where there is no file; renames need no hunk.
    """

    def file(block: Column) -> Column:
        parts = F.split(block, r"(?m)^(?=@@ -)")
        head = parts[0]
        field = lambda p: F.nullif(F.regexp_extract(head, rf"(?m)^{p}([^\t\n]*)", 1), F.lit(""))
        said = lambda i: F.nullif(F.regexp_extract(head, r"^diff --git a/(\S+) b/(\S+)", i), F.lit(""))
        bare = lambda c: F.when(c != "/dev/null", F.regexp_replace(c, "^[ab]/", ""))
        gone, new = F.contains(head, F.lit("\n+++ /dev/null")) | F.contains(head, F.lit("\ndeleted file mode")), F.contains(head, F.lit("\n--- /dev/null")) | F.contains(head, F.lit("\nnew file mode"))
        old_path = F.when(~new, F.coalesce(field("rename from "), bare(field("--- ")), said(1)))
        new_path = F.when(~gone, F.coalesce(field("rename to "), bare(field(r"\+\+\+ ")), said(2)))
        status = F.when(new, "A").when(gone, "D").when(F.contains(head, F.lit("\nrename to ")), "R").otherwise("M")
        return F.struct(old_path.alias("old_path"), new_path.alias("new_path"), status.alias("status"), F.transform(F.slice(parts, 2, F.size(parts)), _hunk).alias("hunks"))

    blocks = F.filter(F.split(diff, r"(?m)^(?=diff --git )"), lambda b: b.startswith("diff --git "))
    return F.transform(blocks, lambda b: once(b, file))


def _side(hunk: Column, sign: str) -> Column:
    """Lines of a hunk's old (-) or new (+) side, without their signs; an empty line is context."""
    other = {"-": "+", "+": "-"}[sign]
    return F.transform(F.filter(hunk["lines"], lambda x: ~F.substring(x, 1, 1).isin(other, "\\")), lambda x: F.substring(x, 2, 1 << 30))


def apply_hunks(before: Column, hunks: Column, reverse: bool = False) -> Column:
    """A file's text after its hunks (or, in reverse, before them); null where the hunks don't fit the text.

    before: null or '' for no lines.  The text keeps or loses its last line's end as the hunks say; a hunk's old lines have to
    stand at the place that its header names.
    """
    was, becomes = ("+", "-") if reverse else ("-", "+")
    at, size_of = ("new_start", "new_len") if reverse else ("old_start", "old_len")
    text = F.coalesce(before, F.lit(""))
    ends = text.endswith("\n")
    bare = F.when(ends, F.left(text, F.length(text) - 1)).otherwise(text)
    rows = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n"))

    def build(rows: Column) -> Column:
        first = lambda h: h[at] + F.when(h[size_of] == 0, 1).otherwise(0)
        after = lambda i: F.when(i == 0, F.lit(1)).otherwise(first(F.get(hunks, i - 1)) + F.get(hunks, i - 1)[size_of])
        count = F.size(hunks)
        piece = lambda i: F.concat(F.slice(rows, after(i), F.greatest(first(F.get(hunks, i)) - after(i), F.lit(0))), _side(F.get(hunks, i), becomes))
        order = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        fits = F.forall(order, lambda i: (first(F.get(hunks, i)) >= after(i)) & (F.slice(rows, first(F.get(hunks, i)), F.get(hunks, i)[size_of]) == _side(F.get(hunks, i), was)))
        tail = F.slice(rows, after(count), F.size(rows) + 1)
        last = F.get(hunks, count - 1)["lines"]
        cut = F.exists(F.sequence(F.lit(1), F.greatest(F.size(last), F.lit(1))), lambda i: F.coalesce(F.get(last, i).startswith("\\") & ~F.get(last, i - 1).startswith(was), F.lit(False)))
        ended = F.when((count > 0) & (F.size(tail) == 0), ~cut).otherwise(ends)
        whole = F.concat(F.flatten(F.transform(order, piece)), tail)
        return F.when(fits, F.concat(F.array_join(whole, "\n"), F.when(ended & (F.size(whole) > 0), "\n").otherwise("")))

    return once(rows, build)
