"""Plain versions of the operators, from the definitions of their results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return SPACED.findall(text or "")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(rows: list[tuple], length: int = 200) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256"""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[s : s + length] for _, r in raw for s in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(r) else 0
        out.append((i, len(r), int(gone.sum()), spans, sha256(kept)))
    return out


def suffix_cut(rows: list[tuple], length: int = 200) -> list[tuple]:
    """doc_id and the text without the bytes that occur elsewhere too (null stays)."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[s : s + length] for r in raw for s in range(len(r) - length + 1))
    out = []
    for (i, t), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = True
        kept, at = "", 0
        for c in t or "":
            # a character goes with any of its bytes
            size = len(c.encode())
            kept, at = kept + ("" if gone[at : at + size].any() else c), at + size
        out.append((i, t if t is None else kept))
    return out


def substring_dedup(rows: list[tuple], window: int = 50) -> list[tuple]:
    """doc_id, n_words, n_removed, kept_sha256"""
    owner: dict[tuple, int] = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[s : s + window])
            owner[key] = min(i, owner.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1) if i is not None else ():
            if owner[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha256(kept.encode())))
    return out


def fingerprint(text: str | None) -> int:
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows: list[tuple], bits: int = 4) -> list[tuple]:
    """doc_id, fingerprint, component_id"""
    prints = [fingerprint(t) for _, t in rows]
    distinct = np.array(sorted(set(prints)), np.uint64)
    root = {int(x): int(x) for x in distinct}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, x in enumerate(distinct):
        for y in distinct[k + 1 :][np.bitwise_count(distinct[k + 1 :] ^ x) <= bits]:
            root[find(int(y))] = find(int(x))
    least: dict[int, int] = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, prints, strict=True)]


def near_copies(rows: list[tuple]) -> list[tuple]:
    """One (doc_id, text) of each class by 5-word shingles, the least doc_id (null: last); its text only if it has no rival."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for k, row in enumerate(rows):
        classes[find(k)].append(row)
    out = []
    for members in classes.values():
        least = min((i for i, _ in members if i is not None), default=None)
        texts = {t for i, t in members if i == least}
        out.append((least, texts.pop() if len(texts) == 1 else "any"))
    return out


def quality(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    out = []
    for i, t in rows:
        w = words(t)
        windows = Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        gone = [False] * len(w)
        for s in range(len(w) - 7):
            if windows[tuple(w[s : s + 8])] > 1:
                gone[s : s + 8] = [True] * 8
        lines = [x for x in (t or "").split("\n") if words(x)]
        repeat = sum(gone)
        out.append(
            (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat,
             len(w) < 20 or 100 * repeat > 30 * len(w))
        )
    return out


def longest_repeat(tokens: list) -> tuple[int, list[int]]:
    """The longest sequence that starts twice, and for each place the longest that starts there and elsewhere."""
    n = len(tokens)
    out = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            k = 0
            while b + k < n and tokens[a + k] == tokens[b + k]:
                k += 1
            out[a], out[b] = max(out[a], k), max(out[b], k)
    return max(out, default=0), out


def decontaminate(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated"""
    owners = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if size else ():
            owners[tuple(w[s : s + size])].add(item)
    sizes = {len(k) for k in owners}
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        gone, names = [False] * len(w), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                found = owners.get(tuple(w[s : s + size]))
                if found:
                    gone[s : s + size] = [True] * size
                    names |= found
        listed = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), sum(gone), len(listed), sha256(",".join(listed).encode()), any(gone)))
    return out


def pieces(rows: list[tuple], path: str) -> list[tuple]:
    """doc_id, n_pieces, pieces_sha256"""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = model.encode([t or "" for _, t in rows], num_threads=1)
    return [(i, len(x), sha256(np.array(x, "<i4").tobytes())) for (i, _), x in zip(rows, encoded, strict=True)]


def verdict(url: str | None, words: tuple[str, ...] = ()) -> tuple[str, str, str | None, str]:
    """host, path, rule, verdict"""
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fitting = []
    for rule in rules:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith(f".{own}")) and path.startswith(f"/{start}"):
            fitting.append(rule)
    if fitting:
        rule = max(fitting, key=len)
        return host, path, rule, rules[rule]
    return host, path, None, "block" if set(re.split("[.-]", host)[:-1]) & set(words) else "allow"


def jaccard(rows: list[tuple], size: int = 3, share: tuple[int, int] = (9, 10)) -> list[tuple]:
    """doc_id, n_shingles, component_id"""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and share[1] * len(x & y) >= share[0] * len(x | y):
                root[find(a)] = find(b)
    least: dict[int, object] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def trie(rows: list[tuple]) -> list[tuple]:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from (conv_id, turn, role, text)"""
    import zlib

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(whole[c]) == len(p))
        out.append((who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], leaves[p], saved[p], sha256(ends.encode())))
    return out


def fill_in_middle(rows: list[tuple], seed: int = 7, rate: int = 100, spm: int = 50) -> list[tuple]:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"""
    out = []
    for i, t in rows:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        drawn = sha256(f"{seed}:{'' if i is None else i}".encode())
        h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = (len("".join(units[:k])) for k in sorted((h1 % (len(units) + 1), h2 % (len(units) + 1))))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            out.append((i, len(units), "plain", None, None, sha256(t.encode()), sha256(t.encode())))
        elif h4 % 100 < spm:
            out.append((i, len(units), "spm", len(p), len(m), sha256(f"<S>{s}<P>{p}<M>{m}".encode()), sha256(t.encode())))
        else:
            out.append((i, len(units), "psm", len(p), len(m), sha256(f"<P>{p}<S>{s}<M>{m}".encode()), sha256(t.encode())))
    return out
