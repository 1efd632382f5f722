"""Plain versions of the operators' contracts, on lists in memory."""

import hashlib
import re
import string
import zlib

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def lines(rows, least=10):
    """rows: (id, text); one (id, n_lines, n_dropped, text) each."""
    holders = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(WHITE).translate(LOWER)
    for i, ls in split:
        for x in ls:
            holders.setdefault(key(x), set()).add(i)
    out = []
    for i, ls in split:
        kept = [x for x in ls if not key(x) or len(holders[key(x)]) < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def words(text):
    return [w for w in re.split(f"[{WHITE}]+", (text or "").translate(LOWER)) if w]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def reach(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(rows, size=5, percent=75):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    links = []
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((sets[x][0], sets[y][0]))
    label = reach({i for i, _ in sets}, links)
    return [(i, len(shingles(t, size)), label.get(i), i is None or label[i] == i) for i, t in rows]
