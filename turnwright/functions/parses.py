"""Semantic parses in bracket or JSON notation as flat lists of nodes with Merkle identities (plain Python, run inside Arrow workers)."""

from __future__ import annotations

import json
import re
from hashlib import blake2b
from json.decoder import scanstring

# Texts, in lower case and with single blanks, that hold no nodes.
NO_NODES = {"semantic no match", "", "nan", "none", "null", "na", "n/a", "<na>", "\\n", "-"}

#: Bytes of an identity: among 10^12 objects the chance that any two share one is below 10^-5.
SIZE = 12

_TOKEN = re.compile(r"(\()|(\))|\[([^\]]*)\]?|([^\s()\[\]]+)")


class Node:
    __slots__ = ("name", "value", "conf", "parent", "kids")

    def __init__(self, name: str, parent: int, value=None, conf=None):
        self.name, self.parent, self.value, self.conf, self.kids = name, parent, value, conf, []


def read(text: str | None) -> list[Node]:
    """Nodes in the order written, each with the place (-1: none) of its parent, which comes before it."""
    if text is None:
        return []
    s = text.strip()
    if " ".join(s.lower().split()) in NO_NODES:
        return []
    if s[0] in '{["':
        try:
            return _from_json(loads(s))
        except ValueError:
            if s[0] != "[":
                return []
    return _from_brackets(s)


def _from_brackets(s: str) -> list[Node]:
    nodes: list[Node] = []
    stack: list[int] = []  # the parent and the last sibling of each open level
    parent = last = -1
    for opened, closed, value, name in _TOKEN.findall(s):
        if name:
            last = len(nodes)
            nodes.append(Node(name, parent))
            if parent >= 0:
                nodes[parent].kids.append(last)
        elif opened:
            stack.append(parent)
            if last >= 0:
                parent = last
            last = -1
        elif closed:
            if stack:
                last, parent = parent, stack.pop()
        elif last >= 0 and nodes[last].value is None:
            nodes[last].value = value
    return nodes


def _from_json(x) -> list[Node]:
    while isinstance(x, str):  # a parse may have been quoted as a JSON string, even more than once
        x = loads(x)
    if isinstance(x, dict) and "slot" not in x:
        x = x.get("nodes")
    nodes: list[Node] = []
    todo = [(y, -1) for y in reversed(_some(x))]
    while todo:
        y, parent = todo.pop()
        if not isinstance(y, dict) or y.get("slot") is None:
            continue
        at = len(nodes)
        nodes.append(Node(str(y["slot"]), parent, y.get("value"), y.get("conf")))
        if parent >= 0:
            nodes[parent].kids.append(at)
        todo += [(z, at) for z in reversed(_some(y.get("sub")))]
    return nodes


def _some(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


_PART = re.compile(r'[ \t\n\r]*(?:([][{}:,])|(")|(true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?))')


def loads(s: str):
    """json.loads for any depth: texts too deep for it are read with a stack of open containers."""
    try:
        return json.loads(s)
    except RecursionError:
        return _deep(s)


def _deep(s: str):
    open_: list = []
    keys: list = []  # of each open object, the key whose value comes next
    want, at = "value", 0
    while True:
        m = _PART.match(s, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        mark, at = m[1], m.end()
        if want in ("value", "item or end") and (not mark or mark in "[{"):
            if mark:
                open_.append([] if mark == "[" else {})
                keys.append(None)
                want = "item or end" if mark == "[" else "key or end"
                continue
            v, at = scanstring(s, at) if m[2] else (json.loads(m[3]), at)
        elif want in ("key", "key or end") and m[2]:
            keys[-1], at = scanstring(s, at)
            want = "colon"
            continue
        elif want == "colon" and mark == ":":
            want = "value"
            continue
        elif want == "more or end" and mark == ",":
            want = "value" if isinstance(open_[-1], list) else "key"
            continue
        elif want.endswith("end") and mark and mark == ("]" if isinstance(open_[-1], list) else "}"):
            v = open_.pop()
            keys.pop()
        else:
            raise ValueError(f"no JSON at {at}")
        if not open_:
            if s[at:].strip():
                raise ValueError(f"more than one value at {at}")
            return v
        if isinstance(open_[-1], list):
            open_[-1].append(v)
        else:
            open_[-1][keys[-1]] = v
        want = "more or end"


def dumps(x) -> str:
    """json.dumps with sorted keys for any depth."""
    try:
        return json.dumps(x, sort_keys=True, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if isinstance(y, _Mark):
                out.append(y)
            elif isinstance(y, dict):
                parts = [z for k in sorted(y) for z in (_Mark(", "), _Mark(json.dumps(k, ensure_ascii=False) + ": "), y[k])][1:]
                todo += [_Mark("}"), *reversed(parts), _Mark("{")]
            elif isinstance(y, list):
                parts = [z for v in y for z in (_Mark(", "), v)][1:]
                todo += [_Mark("]"), *reversed(parts), _Mark("[")]
            else:
                out.append(json.dumps(y, ensure_ascii=False))
        return "".join(out)


class _Mark(str):
    """Text that is written as it is."""


def identify(nodes: list[Node]) -> tuple[list[bytes], list[int], bytes]:
    """Bottom-up identity and height of each node, and the identity of the whole text.

    Equal names, values, confidences and equal children in equal order give the same SIZE bytes.
    """
    n = len(nodes)
    ids: list[bytes] = [b""] * n
    height = [1] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        value = dumps(x.value) if isinstance(x.value, (dict, list)) else x.value
        h = blake2b(f"{x.name!r} {value!r} {x.conf!r}".encode("utf-8", "surrogatepass"), digest_size=SIZE)
        if x.kids:
            h.update(b"\x00")
            for k in x.kids:
                h.update(ids[k])
                height[i] = max(height[i], height[k] + 1)
        ids[i] = h.digest()
    whole = blake2b(b"whole", digest_size=SIZE)
    for i in range(n):
        if nodes[i].parent < 0:
            whole.update(ids[i])
    return ids, height, whole.digest()


_WORD = re.compile(r"\(|\)|\w+\[.*?\]|\w+")


def nested_counts(text: str) -> dict:
    """How often each value, or name, stands under each name of a parse in bracket notation, nested as the brackets are.

    A name followed by names counts them, one followed by a group holds what the group counts (the last group, if several); a name with a value
    counts the value. A closing mark leads back to the group around it; of unclosed groups only the innermost is the result. A name that holds a
    group and then comes again as a plain name keeps the group.
    """
    if text.strip().lower() == "semantic no match":
        text = "semantic_no_match"
    here: dict = {}
    key = None
    around: list[tuple[dict, str | None]] = []
    for t in _WORD.findall(text):
        if t == "(":
            inner: dict = {}
            if key is not None:
                here[key] = inner
            around.append((here, key))
            here, key = inner, None
        elif t == ")":
            if around:
                here, key = around.pop()
        elif t.endswith("]"):
            key, value = t[:-1].split("[", 1)
            if not isinstance(here.get(key), dict):
                here[key] = {}
            _count(here[key], value)
        elif key is None:
            _count(here, t)
            key = t
        else:
            if not isinstance(here[key], dict):
                here[key] = {}
            _count(here[key], t)
    return here


def _count(d: dict, name: str) -> None:
    n = d.get(name, 0)
    if not isinstance(n, dict):
        d[name] = n + 1
