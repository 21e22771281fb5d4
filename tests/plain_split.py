"""The recursive split as plain Python, for comparison."""

SEPARATORS = ["\n\n", "\n", " ", ""]


def split_text(text, size, overlap, separators=None):
    """(start, piece) of every chunk."""

    def parts_of(text, at, separators, groups):
        sep = next((s for s in separators if s == "" or s in text), separators[-1])
        finer = separators[separators.index(sep) + 1 :]
        pieces = text.split(sep) if sep else list(text)
        pieces = [p for i, p in enumerate(pieces) for p in ([sep + p] if i and sep else [p]) if p]
        groups.append([])
        for p in pieces:
            if len(p) < size or not finer:
                groups[-1].append((at, p))
            else:
                parts_of(p, at, finer, groups)
                groups.append([])
            at += len(p)

    groups, out = [], []
    parts_of(text, 0, SEPARATORS if separators is None else separators, groups)
    for group in groups:
        run = []

        def emit(run=run):
            joined = "".join(p for _, p in run)
            if joined.strip():
                out.append((run[0][0] + len(joined) - len(joined.lstrip()), joined.strip()))

        for part in group:
            if run and sum(len(p) for _, p in run) + len(part[1]) > size:
                emit()
                while run and (sum(len(p) for _, p in run) > overlap or sum(len(p) for _, p in run) + len(part[1]) > size):
                    run.pop(0)
            run.append(part)
        if run:
            emit()
    return out
