"""Plain versions of the contracts."""

import hashlib
import math
import re
import zlib

import xxhash

GAP = r"[^\x20\x09-\x0D]+"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(text):
    w = re.findall(GAP, fold(text))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def simhash(rows):
    """rows (doc_id, text) to a list of (doc_id, hex, component)."""
    fp = [fingerprint(t) for _, t in rows]
    names = sorted(set(fp))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(rows, fp, strict=True):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(rows, fp, strict=True)]


def near_groups(texts, k=5):
    """The group of each text: least index reached over pairs with a shingle similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = re.findall(GAP, fold(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def quality(text):
    text = text or ""
    w = re.findall(GAP, text)
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(GAP, x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def repeats(rows):
    """rows (doc_id, text) to a list of (doc_id, bytes, removed, spans, digest)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for s in {b[i : i + 50] for i in range(len(b) - 49)}:
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def decontaminate(rows, items):
    windows = {}
    for i, t in items:
        w = re.findall(WORD, fold(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = re.findall(WORD, fold(t))
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        ids.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def xx(*parts):
    """Spark's xxhash64 of strings."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h


def weight(node):
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def shard(doc_id, tree):
    path, node = "", tree
    while isinstance(node, dict):
        draw = lambda k: -math.log(((xx(str(doc_id) if doc_id is not None else "null", f"{path}/{k}") >> 11) + 0.5) / 2**53) / weight(node[k])  # noqa: B023, E731
        best = min(node, key=draw) if len(node) > 1 else next(iter(node))
        path, node = f"{path}/{best}", node[best]
    return int(path.rsplit("/", 1)[1])


def size_and_crc(text):
    b = (text or "").encode()
    return len(b) + 1, zlib.crc32(b)


def fused(rows, n, prior, value):
    """rows (host, domain, declared, suffix, log likelihoods) to (language number, posterior, what the text alone says)."""
    said = [max(range(n), key=lambda i: (r[4][i], -i)) for r in rows]
    count = lambda same: [sum(1 for r, s in zip(rows, said, strict=True) if s == i and same(r)) for i in range(n)]
    every = count(lambda r: True)
    base = [(c + prior / n) / (len(rows) + prior) for c in every]
    smooth = lambda own, above: [(c + prior * p) / (sum(own) + prior) for c, p in zip(own, above, strict=True)]
    out = []
    for r, s in zip(rows, said, strict=True):
        domain = smooth(count(lambda x: x[1] == r[1]), base)  # noqa: B023
        host = smooth(count(lambda x: x[:2] == r[:2]), domain)  # noqa: B023
        logs = [a + math.log(b) for a, b in zip(r[4], host, strict=True)]
        for k in (2, 3):
            own = count(lambda x: x[k] == r[k])  # noqa: B023
            kinds = len({x[k] for x in rows})
            logs = [a + math.log((c + value) / (t + value * kinds)) for a, c, t in zip(logs, own, every, strict=True)]
        top = max(logs)
        out.append((logs.index(top), 1 / sum(math.exp(x - top) for x in logs), s))
    return out


def contained(words, template, k=5, share=0.8):
    """Whether some run of as many words as the template holds so much of its shingles."""
    shingles = {tuple(template[i : i + k]) for i in range(len(template) - k + 1)}
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    width = len(template) - k + 1
    return any(len(shingles & set(runs[i : i + width])) >= share * len(shingles) for i in range(max(1, len(runs) - width + 1)))


def page_events(kids, parent=None):
    """What a tree of (tag, attributes, kids) and strings does to the lines of a page."""
    for kid in kids:
        if isinstance(kid, str):
            yield "text", kid
            continue
        tag, attrs, inner = kid
        if "hidden" in attrs or tag == "script":
            continue
        if tag in ("p", "div"):
            around = "gap" if tag == "p" else "close"
            yield around, None
            yield from page_events(inner, tag)
            yield around, None
        elif tag in ("ul", "ol"):
            lines = []
            for n, (_, _, item) in enumerate([x for x in inner if "hidden" not in x[1]], 1):
                mark = f"{n}. " if tag == "ol" else "- "
                lines += [(" " * len(mark) if i else mark) + x if x else "" for i, x in enumerate(page_lines(item, "li") or [""])]
            yield ("close" if parent == "li" else "gap"), None
            yield "lines", lines
            yield ("close" if parent == "li" else "gap"), None
        elif tag == "table":
            grid, taken = [], set()
            for y, (_, _, cells) in enumerate(inner):
                x, row = 0, []
                for _, a, cell in cells:
                    while (y, x) in taken:
                        x += 1
                    wide, high = int(a.get("colspan", 1)), int(a.get("rowspan", 1))
                    taken |= {(y + j, x + i) for i in range(wide) for j in range(high)}
                    row.append((x, wide, page_lines(cell, "td")))
                    x += wide
                grid.append(row)
            columns = sorted({x for row in grid for x, _, _ in row})
            width = {c: max([len(s) for row in grid for x, wide, cell in row if x == c and wide == 1 for s in cell], default=0) for c in columns}
            lines = []
            for row in grid:
                for i in range(max([len(cell) for _, _, cell in row], default=0)):
                    s = ""
                    for x, _, cell in row:
                        if i < len(cell) and cell[i]:
                            s = s.ljust(max(sum(width[c] + 2 for c in columns if c < x), len(s) + 2 if s else 0)) + cell[i]
                    lines.append(s)
            yield "gap", None
            yield "lines", lines
            yield "gap", None
        else:
            yield from page_events(inner, tag)


def page_lines(kids, parent=None):
    lines, line = [], ""
    for what, x in [*page_events(kids, parent), ("close", None)]:
        if what == "text":
            line += x
            continue
        if line.split():
            lines.append(" ".join(line.split()))
        line = ""
        if what == "gap" and lines and lines[-1]:
            lines.append("")
        lines += x or []
    while lines and not lines[-1]:
        lines.pop()
    return lines
