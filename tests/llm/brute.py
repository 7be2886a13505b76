"""Plain single-process versions of the contracts, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS8 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def simhash(text):
    words = BLANKS.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def op1(docs):
    """docs: [(doc_id, text)] -> {doc_id: (hex, component)}"""
    prints = [(d, simhash(t)) for d, t in docs]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)]


def op2(docs, width=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w not in first or d < first[w]:
                first[w] = d
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def op8(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = WORDS8.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, text in docs:
        w = WORDS8.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (at := tuple(w[i : i + n])) in windows:
                    found |= windows[at]
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op9(docs):
    out = []
    for d, text in docs:
        text = text or ""
        words = BLANKS.findall(text)
        lines = [x for x in text.split("\n") if BLANKS.search(x)]
        seen, covered = {}, set()
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered.update(p + k for p in places for k in range(3))
        symbols = sum(c in "#*$%&|<>" for c in text)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((d, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    return out


def op5_facts(text):
    data = (text or "").encode()
    return len(data) + 1, zlib.crc32(data)


def op3_pieces(text, most=12, least=4):
    """[(begin, end, words)] of a text's pieces, from the rule alone."""
    text = text or ""
    parts = [m for m in re.finditer(r"[^\s。…]+[。…]*[\"'”’)\]]*\s*|[。…]+[\"'”’)\]]*\s*", text)]
    if not parts:
        return [(0, len(text), [])] if text else []
    sentences, now = [], []
    for m in parts:
        now.append(m)
        bare = m.group().rstrip()
        if "\n" in m.group()[len(bare) :] or re.search(r"(?:[.!?]+[\"'”’)\]]*|[。…]+[\"'”’)\]]*)$", bare) and (m.group() != bare or m.end() == len(text) or re.search(r"[。…]+[\"'”’)\]]*$", bare)):
            sentences.append(now)
            now = []
    if now:
        sentences.append(now)

    def mix(x):
        x = ((x ^ (x >> 32)) * 0x165667B19E3779F9) % 2**64
        return x ^ (x >> 29)

    def word_hash(w):
        return mix(sum(mix((ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64) * pow(0xD1342543DE82EF95, k, 2**64) for k, c in enumerate(w)) % 2**64)

    def lower(w):
        return "".join(c.lower() if len(c.lower()) == 1 else c for c in w)

    groups = []
    for own in sentences:
        words = [lower(m.group().strip()) for m in own]
        n = len(words)
        pair = [0] + [mix((word_hash(a) * 0x9E3779B97F4A7C15 + word_hash(b) * 0xC2B2AE3D27D4EB4F) % 2**64) for a, b in zip(words, words[1:])]
        cuts = [0]
        if n > most:
            for p in [*(p for p in range(least, n - least + 1) if pair[p] < min(pair[p - 3 : p]) and pair[p] <= min(pair[p + 1 : p + 4])), n]:
                while p - cuts[-1] > most:
                    places = range(cuts[-1] + least, min(cuts[-1] + most, p - least) + 1)
                    cuts.append(min(places, key=lambda k: (pair[k], k)))
                if p < n:
                    cuts.append(p)
        for a, b in zip(cuts, [*cuts[1:], n]):
            groups.append((own[a].start(), own[b - 1].end(), words[a:b]))
    groups[0] = (0, *groups[0][1:])
    return groups


def op3(docs, run=3):
    """[(doc_id, n_sentences, n_removed, removed_words, text left)]; docs in the order of their ids."""
    cut = [(d, t or "", op3_pieces(t)) for d, t in docs]
    first = {}
    for k, (_, _, pieces) in enumerate(cut):
        for at in range(len(pieces) - run + 1):
            first.setdefault(tuple(tuple(w) for *_, w in pieces[at : at + run]), (k, at))
    out = []
    for k, (d, text, pieces) in enumerate(cut):
        gone = set()
        for at in range(len(pieces) - run + 1):
            if first[tuple(tuple(w) for *_, w in pieces[at : at + run])] != (k, at):
                gone |= set(range(at, at + run))
        kept = "".join(text[a:b] for n, (a, b, _) in enumerate(pieces) if n not in gone)
        out.append((d, len(pieces), len(gone), sum(len(pieces[n][2]) for n in gone), kept))
    return out


def op10(rows, targets, keep, seed):
    """[(weight, probability, sampled)] for rows (doc_id, text, lang, source, topic, n_tokens), topics given."""
    dims = ("source", "lang", "topic")

    def cell(r):
        given = {"source": r[3], "lang": r[2], "topic": r[4]}
        return tuple(given[d] if given[d] in targets[d] else "other" for d in dims)

    tokens = {}
    for r in rows:
        assert r[5] == len(BLANKS.findall(r[1] or ""))
        tokens[cell(r)] = tokens.get(cell(r), 0) + r[5]
    tokens = {c: n for c, n in tokens.items() if n}
    weight = {c: n / sum(tokens.values()) for c, n in tokens.items()}
    for _ in range(3000):
        for k, d in enumerate(dims):
            names = {c[k] for c in weight}
            want = {n: targets[d].get(n, max(0.0, 1 - sum(targets[d].values())) if n == "other" else 0.0) for n in names}
            total = sum(want.values())
            want = {n: (x / total if total > 0 else 1 / len(names)) for n, x in want.items()}
            have = {n: sum(w for c, w in weight.items() if c[k] == n) for n in names}
            weight = {c: w * (want[c[k]] / have[c[k]] if have[c[k]] > 0 else 0.0) for c, w in weight.items()}
            every = sum(weight.values())
            weight = {c: w / every for c, w in weight.items()}
    chance, whole, budget = {c: 0.0 for c in weight}, set(), keep * sum(tokens.values())
    while True:
        free = [c for c in weight if c not in whole and weight[c] > 0]
        left = budget - sum(tokens[c] for c in whole)
        if left <= 0 or not free:
            break
        share = sum(weight[c] for c in free)
        for c in free:
            chance[c] = min(1.0, left * weight[c] / share / tokens[c])
        full = {c for c in free if chance[c] >= 1}
        if not full:
            break
        whole |= full
    out = []
    for r in rows:
        drawn = int(hashlib.md5(f"{seed}:{r[0] if r[0] is not None else r[1] or ''}".encode()).hexdigest()[:12], 16) / 16**12
        p = chance.get(cell(r), 0.0)
        out.append((weight.get(cell(r), 0.0), p, drawn < p))
    return out
