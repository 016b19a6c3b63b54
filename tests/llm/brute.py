"""Plain Python answers to the corpus contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = "\t\n\x0b\x0c\r "


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def op1(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def op3_counts(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    repeated = {p for i, k in enumerate(windows) if counts[k] > 1 for p in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeated))


def op5(docs, size=3, radius=3):
    def fingerprint(text):
        w = SPACED.findall((text or "").translate(LOWER))
        if not w:
            return 0
        shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in docs]
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = root(i)
        known = least.get(r)
        least[r] = known if doc is None or (known is not None and known < doc) else doc
    return [(doc, f"{fps[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(docs)]


def op6(docs, size=400):
    starts = Counter()
    data = [(t or "").encode() for _, t in docs]
    for b in data:
        starts.update(b[i:i + size] for i in range(len(b) - size + 1))
    out = []
    for (doc, _), b in zip(docs, data):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if starts[b[i:i + size]] > 1:
                gone[i:i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def op8(docs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(BLANK).translate(LOWER)

    owners = defaultdict(list)
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            owners[k].append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in owners.items()
            if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op9(docs, size=50):
    first = {}
    rank = [float("inf") if doc is None else doc for doc, _ in docs]
    for r, (_, text) in zip(rank, docs):
        w = SPACED.findall(text or "")
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, r), r)
    out = []
    for r, (doc, text) in zip(rank, docs):
        w = SPACED.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < r:
                gone |= set(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), sha(" ".join(kept))))
    return out


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def op12(docs, a, b, byte_of):
    """``a`` a tokenizer, ``b`` a piece model; rows as the contract orders them."""
    entry = {i: bytes(byte_of[c] for c in e) for e, i in a.get_vocab().items()}

    def tokens(text):
        data = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids[1]]
        spelt = ([entry[i] for i in ids[0]], [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces)])
        return (ids, spelt) if all(b"".join(s) == data for s in spelt) else None

    def groups(ids, spelt):
        ends = [list(accumulate(map(len, s))) for s in spelt]
        out, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            group = []
            for k in (0, 1):
                begin = at[k]
                while at[k] < len(ends[k]) and ends[k][at[k]] <= end:
                    at[k] += 1
                group.append(ids[k][begin:at[k]])
            out.append(group)
        return out

    of_doc, counts = [], Counter()
    for doc, text in docs:
        known = tokens(text) if text else None
        found = groups(*known) if known else []
        links = Counter((x, y) for g in found for x in g[0] for y in g[1])
        counts.update(links.keys())
        of_doc.append((doc, known, found, links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for doc, known, found, links in of_doc:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        out.append((
            doc, *(map(len, known[0]) if known else (0, 0)), len(found), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links.items()),
            sha(text) if known else ""))
    return out


def crc(value):
    return zlib.crc32(str(value).encode())


def op13(rows, family=100, shares=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, listed in own.items():
        h = crc(c) % shares
        base = c - (abs(c) % family if c >= 0 else -(abs(c) % family))
        whole[c] = own.get(base, [])[:h] + listed[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        path = tuple(whole[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[node]]
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(x for x, _ in below) or 1, own_saved + sum(y for _, y in below))
    return [(
        v[0], len(node), members[node[:-1]][0] if node else None, len(v), len(children[node]), *totals[node],
        sha(",".join(map(str, ends[node])))) for node, v in members.items()]
