"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LAST = (1 << 63) - 1


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def components(docs, shingle=4, least=85):
    """Counter of (doc_id, n_shingles, component_id)."""
    rows = []
    for i, text in docs:
        w = words(text)
        rows.append((i, frozenset(tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])))
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    by_set, holding = defaultdict(list), defaultdict(list)
    for i, s in rows:
        if s and i is not None:
            by_set[s].append(i)
    sets = list(by_set)
    for k, s in enumerate(sets):
        for i in by_set[s]:
            union(by_set[s][0], i)
        for x in s:
            holding[x].append(k)
    for k, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in holding[x] if j > k).items():
            if 100 * common >= least * (len(s) + len(sets[j]) - common):
                union(by_set[s][0], by_set[sets[j]][0])
    return Counter((i, len(s), None if i is None else find(i) if s else i) for i, s in rows)


def repeats(docs, window=100):
    """List of (doc_id, n_bytes, n_removed, n_spans, kept bytes), in the order of docs."""
    rows = [(LAST if i is None else i, (text or "").encode(), i) for i, text in docs]
    first = {}
    for key, data, _ in rows:
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            first[w] = min(first.get(w, (key, p)), (key, p))
    out = []
    for key, data, i in rows:
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if first[data[p : p + window]] < (key, p):
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)))
    return out


def leaked_items(text, benchmark, window=13, allowed=2, shortest=8):
    """Ids of benchmark items (id, text) that the text holds a window of."""
    w, found = words(text), set()
    for i, item in benchmark:
        x = words(item)
        if len(x) < shortest:
            continue
        size, free = (window, allowed) if len(x) >= window else (len(x), 0)
        for shift in range(-len(x), len(w)):
            same = [0 <= shift + j < len(w) and w[shift + j] == x[j] for j in range(len(x))]
            if sum(same) < size - free:
                continue
            if any(shift + s >= 0 and shift + s + size <= len(w) and sum(same[s : s + size]) >= size - free for s in range(len(x) - size + 1)):
                found.add(i)
                break
    return found


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_rules(docs, limit=10):
    """Dict of doc_id to the metrics, for distinct ids; docs: (doc_id, source, text)."""
    norm = lambda line: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))
    seen, out = defaultdict(set), {}
    for i, host, text in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[host, norm(line)].add(i)
    for i, host, text in docs:
        text = text or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        frequent = [x for x in lines if len(seen[host, norm(x)]) > limit]
        lost = sum(len(WORD.findall(x)) for x in frequent)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out[i] = {
            "n_words": len(w),
            "word_chars": sum(map(len, w)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered),
            "base_failed": failed,
            "n_removed_lines": len(frequent),
            "n_removed_words": lost,
            "kept": not failed and 2 * (len(w) - lost) >= len(w),
        }
    return out


TAG = re.compile(r"<!--.*?-->|<![^>]*>|<(/?)([a-z0-9]+)((?:\s[^>]*)?)>", re.S)


def page_texts(rows, many=10):
    """Dict of page id to main text by template counting alone, two passes over trees of strings; well-formed pages."""
    from waymark.llm import page_text as t

    def tree(html):
        root = {"tag": "", "sign": "", "items": [], "article": False, "prose": False}
        stack, at, html = [root], 0, html or ""
        for raw in t.RAW:
            html = re.sub(rf"<{raw}\b.*?</{raw}>", "<wbr>", html, flags=re.S)
        for m in TAG.finditer(html):
            stack[-1]["items"].append(html[at : m.start()])
            at = m.end()
            end, tag, attributes = m[1], m[2], m[3] or ""
            if not tag:
                continue
            if tag not in t.PROSE | t.CONTAINER:
                stack[-1]["items"].append(" " if tag in t.VOID else "")
                continue
            if end:
                if any(n["tag"] == tag for n in stack):
                    while stack.pop()["tag"] != tag:
                        pass
                else:
                    stack[-1]["items"].append(None)
                continue
            while tag in t.PROSE and stack[-1]["tag"] in t.PROSE and stack[-1]["tag"] in (tag, "p"):
                stack.pop()
            said = re.findall(r"[a-z]+", " ".join(re.findall(r"(?:class|id)=[\"']([^\"']*)", attributes)).lower())
            up = stack[-1]
            node = {"tag": tag, "sign": f"{tag} {sorted(set(said))}", "items": [], "article": up["article"] or tag in ("article", "main"), "prose": up["prose"] or tag in t.PROSE}
            up["items"].append(node)
            stack.append(node)
        stack[-1]["items"].append(html[at:])
        return root

    plain = lambda x: " ".join(x.split())
    size = lambda n: sum(size(x) if isinstance(x, dict) else len(plain(x or "")) for x in n["items"])
    words = lambda n: (n["sign"], *(words(x) if isinstance(x, dict) else plain(x) for x in n["items"] if isinstance(x, dict) or plain(x or "")))

    def shape(n):
        inner = [shape(x) for x in n["items"] if isinstance(x, dict)]
        return (n["sign"], *(x for i, x in enumerate(inner) if i == 0 or inner[i - 1] != x))

    content = lambda n: n["tag"] in ("p", "h1", "pre", "blockquote") or any(content(x) for x in n["items"] if isinstance(x, dict))

    def visit(n, path, found):
        here = (*path, n["sign"])
        if n["tag"] in t.CONTAINER - {"html", "body", "article", "main"} and not (n["article"] and n["prose"]) and size(n):
            n["keys"] = [("w", words(n))] + ([] if n["article"] or content(n) else [("s", here, shape(n))])
            for k in n["keys"]:
                found[k] = found.get(k, 0) + size(n)
        for x in n["items"]:
            if isinstance(x, dict):
                visit(x, here, found)

    host = lambda url: (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "") or [0, ""])[1].lower()
    trees, seen, n_host = {}, defaultdict(list), Counter()
    for i, url, html in rows:
        trees[i], found = tree(html), {}
        visit(trees[i], (), found)
        n_host[host(url)] += 1
        for k, n in found.items():
            seen[host(url), k].append(n / size(trees[i]))
    out = {}
    for i, url, _ in rows:
        blocks = [[]]

        def emit(n):
            for x in n["items"]:
                if isinstance(x, str):
                    blocks[-1].append(x)
                    continue
                blocks.append([])
                if x is not None:
                    shares = {k: seen[host(url), k] for k in x.get("keys", ())}
                    if not any(len(s) >= many and (k[0] == "w" or (2 * len(s) >= n_host[host(url)] and sum(s) / len(s) < 1 / 3)) for k, s in shares.items()):
                        emit(x)
                    blocks.append([])

        emit(trees[i])
        import html as references

        out[i] = "\n\n".join(b for b in (" ".join(references.unescape("".join(b)).split()) for b in blocks) if b)
    return out


def groups_of(docs, shingle=4, least=85):
    """The groups of linked sets, one for each set."""
    return _linked(docs, shingle, least)[1].values()


def components_by_set(docs, shingle=4, least=85):
    """Counter of (doc_id, n_shingles, component_id) where a set, and no id, is what links; rows with a null id link with nothing."""
    rows, group = _linked(docs, shingle, least)
    first = {}
    for g in group.values():
        if id(g) not in first:
            first[id(g)] = min(i for i, x in rows if x in g and i is not None)
    return Counter((i, len(s), i if i is None or not s else first[id(group[s])]) for i, s in rows)


def _linked(docs, shingle, least):
    rows = []
    for i, text in docs:
        w = words(text)
        rows.append((i, frozenset(tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])))
    sets = sorted({s for i, s in rows if s and i is not None}, key=len)
    group = {s: {s} for s in sets}
    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            if 100 * len(a) < least * len(b):
                break
            both = len(a & b)
            if 100 * both >= least * (len(a) + len(b) - both) and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    return rows, group


def search(docs, items, k=20):
    """(item_id, rank, doc_id, score) of every distinct item, by scoring every document."""
    import math
    import re

    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    held = [(i, Counter(cut(text))) for i, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, c in held:
            if i is None or not c:
                continue
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in cut(text) if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def manifest(rows, fanout=2):
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    import zlib

    digest = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(field, r))

    def tree(nodes):
        """(root, for each node its siblings by level: (left, right))"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
                paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
            nodes, at = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [p // fanout for p in at]
        return nodes[0], paths

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by_lang[lang]])
    root, above = tree([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for r, path in zip(by_lang[lang], trees[lang][1], strict=True):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc, siblings = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r), ""
            for left, right in path + above[k]:
                acc, siblings = digest(left, acc, right), siblings + left + right
            out.append((r[0], leaf(r), trees[lang][0], root, digest(siblings), acc, acc == root))
    return out
