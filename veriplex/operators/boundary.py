"""Where one node ends and the next begins, and which members of a node are coded together: functions of keys alone."""

from __future__ import annotations

import numpy as np

from ..functions.blake3 import blake3_many
from ..functions.gf256 import encode, repair
from ..functions.keys import class_of
from .node import HEADER, PARITY_KIND, RAW, TREE_NODE, MAX_NODE, Node, block_ids, parse

# Fixed values of the format.
LAMBDA, MIN_SPLIT, MAX_LOGICAL = 4400, 1024, 12288
SPLIT_DOMAIN, GROUP_DOMAIN = b"PT01-split", b"PT01-pgroup"
PARITY, MIN_GROUP, MAX_GROUP = 8, 21, 36
CLOSE_BELOW = (2**32 - 1) // 3 + 1


def key_hashes(domain: bytes, level: int, keys: list[bytes]) -> np.ndarray:
    """The first four bytes of each key's hash, little-endian."""
    return np.frombuffer(b"".join(d[:4] for d in blake3_many([domain + bytes([level]) + k for k in keys])), "<u4")


def split_hash(level: int, key: bytes) -> int:
    return int(key_hashes(SPLIT_DOMAIN, level, [key])[0])


def splits_after(h: int, before: int, after: int) -> bool:
    return after >= MIN_SPLIT and h * LAMBDA**4 < (after**4 - before**4) << 32


class Chunker:
    """The fold over the entries of a level: True from starts(h, cost) means that the entry opens a node."""

    def __init__(self, rule=splits_after) -> None:
        self.size, self.closed, self.rule = HEADER, True, rule

    def starts(self, h: int, cost: int) -> bool:
        opens = self.closed or self.size + cost > MAX_LOGICAL
        before = HEADER if opens else self.size
        self.size = before + cost
        self.closed = self.rule(h, before, self.size)
        return opens


class BoundaryError(Exception):
    """A node that the chunker cannot have made: InteriorSplit, TooLarge or WrongParityCount."""

    def __init__(self, kind: str, detail: object = None) -> None:
        super().__init__(kind)
        self.kind, self.detail = kind, detail


def group_sizes(hashes: list[int]) -> list[int]:
    sizes, held = [], 0
    for h in hashes:
        held += 1
        if held == MAX_GROUP or held >= MIN_GROUP and h < CLOSE_BELOW:
            sizes.append(held)
            held = 0
    if held and sizes and held < MIN_GROUP and sizes[-1] + held <= MAX_GROUP:
        sizes[-1] += held
    elif held:
        sizes.append(held)
    return sizes


def groups(node: Node) -> list[tuple[int, list[int]]]:
    """(class, entries) of each parity group: a branch's children; a leaf's referenced values, class by class."""
    if node.level:
        runs = [(0, list(range(len(node))))]
    else:
        refs = [(i, class_of(v.length)) for i, v in enumerate(node.values) if v.is_ref]
        runs = [(c, [i for i, own in refs if own == c]) for c in range(4)]
    asked = [i for _, members in runs for i in members]  # a leaf of inline values asks for none
    hashes = dict(zip(asked, key_hashes(GROUP_DOMAIN, node.level, [node.keys[i] for i in asked]).tolist(), strict=True)) if asked else {}
    out = []
    for c, members in runs:
        at = 0
        for n in group_sizes([hashes[i] for i in members]):
            out.append((c, members[at:at + n]))
            at += n
    return out


def member_ids(node: Node) -> list[tuple[int, list[bytes]]]:
    take = (lambda i: node.children[i][0]) if node.level else (lambda i: node.values[i].cid)
    return [(c, [take(i) for i in own]) for c, own in groups(node)]


def check_node(node: Node) -> None:
    """Refuses a node that the rules cannot give; the last entry may close it or not."""
    size = HEADER
    if node.logical_length > MAX_LOGICAL:
        raise BoundaryError("TooLarge")
    hashes = key_hashes(SPLIT_DOMAIN, node.level, node.keys).tolist() if node.keys else []
    for i, (h, cost) in enumerate(zip(hashes, node.costs(), strict=True)):
        if i + 1 < len(node) and splits_after(h, size, size + cost):
            raise BoundaryError("InteriorSplit", i)
        size += cost
    want = PARITY * len(groups(node))
    if len(node.parity) != want:
        raise BoundaryError("WrongParityCount", (want, len(node.parity)))


def symbol(state: bytes) -> bytes:
    return len(state).to_bytes(4, "little") + state


def encode_group(states: list[bytes]) -> list[bytes]:
    """The parity bodies of a group; a state is a member's kind byte and body."""
    return encode([symbol(s) for s in states], PARITY)


def repair_group(k: int, have: list[bytes | None], max_length: int) -> list[bytes]:
    return [s[4:] for s in repair(k, PARITY, have, max_length)]


def update_group(parity: list[bytes], column: int, old: bytes, new: bytes) -> list[bytes]:
    """The parity after one member changed in place, from the old parity and the two states alone."""
    from ..functions.gf256 import MUL, RsError, coefficient, trim

    if len(parity) != PARITY:
        raise RsError("Ragged")
    if column >= MAX_GROUP:
        raise RsError("GroupSize", column + 1)
    width = max(len(p) for p in [*parity, symbol(old), symbol(new)])
    wide = lambda s: np.frombuffer(s.ljust(width, b"\0"), np.uint8)
    change = wide(symbol(old)) ^ wide(symbol(new))
    return [trim((wide(p) ^ MUL[coefficient(r, column)][change]).tobytes()) for r, p in enumerate(parity)]


MAX_MEMBER_VALUE, MAX_MEMBER_NODE = 1 + 262144, 1 + MAX_NODE


def parity_bodies(node: Node, bodies) -> list[bytes]:
    """The bodies of the node's parity, in order; bodies(entry) is the body of a child or referenced value."""
    kind = bytes([TREE_NODE if node.level else RAW])
    return [p for _, own in groups(node) for p in encode_group([kind + bodies(i) for i in own])]


def parity_of(nodes: list[Node], bodies: list) -> list[list[tuple[bytes, bytes]]]:
    """(id, body) of the parity of each of some nodes, in order; their blocks are hashed together."""
    coded = [parity_bodies(node, own) for node, own in zip(nodes, bodies, strict=True)]
    ids = iter(block_ids([(PARITY_KIND, p) for out in coded for p in out]))
    return [[(next(ids), p) for p in out] for out in coded]


def parity_blocks(node: Node, bodies) -> list[tuple[bytes, bytes]]:
    """(id, body) of the node's parity, in order; bodies(entry) is the body of a child or referenced value."""
    return parity_of([node], [bodies])[0]


class GroupIndex:
    """The parity ids of the groups of nodes that are being replaced: a group's parity is a function of its members alone."""

    def __init__(self, nodes=()) -> None:
        self.exact: dict[tuple, list[bytes]] = {}
        self.near: dict[tuple, tuple[bytes, list[bytes]]] = {}
        for node in nodes:
            found = member_ids(node)
            if len(node.parity) != PARITY * len(found):
                continue  # nothing is built on a node that breaks the rules
            for i, (c, members) in enumerate(found):
                ids = node.parity[PARITY * i:PARITY * (i + 1)]
                self.exact.setdefault((c, tuple(members)), ids)
                for at, cid in enumerate(members):
                    self.near.setdefault((c, at, *members[:at], None, *members[at + 1:]), (cid, ids))

    def one_off(self, c: int, members: list[bytes]) -> tuple[int, bytes, list[bytes]] | None:
        """(place, old member, parity ids) of a group that differs in one place."""
        for at in range(len(members)):
            got = self.near.get((c, at, *members[:at], None, *members[at + 1:]))
            if got is not None:
                return at, *got
        return None


def parity_reusing(node: Node, index: GroupIndex, find) -> tuple[list[bytes], list[tuple[bytes, bytes]], list[bytes]]:
    """(parity ids, (id, body) of what had to be coded, blocks that were lacking). A known group is copied; one with a member
    changed in place is corrected from the two members and the old parity; others are coded from their members. find(id): a body or None."""
    kind = bytes([TREE_NODE if node.level else RAW])
    ids, coded, need = [], [], []
    for c, members in member_ids(node):
        known = index.exact.get((c, tuple(members)))
        if known is not None:
            ids += known
            continue
        near = index.one_off(c, members)
        wanted = list(members)
        if near is not None and any(find(m) is None for m in members):
            wanted = [near[1], members[near[0]], *near[2]]
        lost = [m for m in wanted if find(m) is None]
        if lost:
            need += lost
            continue
        if near is not None and all(find(m) is not None for m in (near[1], *near[2])):
            bodies = update_group([find(p) for p in near[2]], near[0], kind + find(near[1]), kind + find(members[near[0]]))
        else:
            bodies = encode_group([kind + find(m) for m in members])
        made = list(zip(block_ids([(PARITY_KIND, p) for p in bodies]), bodies, strict=True))
        ids += [cid for cid, _ in made]
        coded += made
    return ids, coded, need


def fraud(parent: bytes, child: bytes) -> bool:
    """Whether the two blocks contradict each other: a child that the parent names, but with another aggregate, level or first key."""
    try:
        p, c = parse(parent), parse(child)
    except Exception:  # garbage accuses nobody
        return False
    cid = block_ids([(TREE_NODE, child)])[0]
    named = [i for i, x in enumerate(p.children) if x[0] == cid]
    if not named:
        return False
    i = named[0]
    return p.children[i][1:] != c.agg or c.level + 1 != p.level or not c.keys or c.keys[0] != p.keys[i]
