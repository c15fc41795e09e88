"""The format: hashes, codes, nodes, boundaries, packs and proofs against fixed values and mutations."""

import random

import pytest
from conftest import dataset

import veriplex.functions.blake3 as blake3_module
from veriplex.functions.blake3 import blake3, blake3_many
from veriplex.functions.gf256 import MUL, RsError, coefficient, div, encode
from veriplex.functions.keys import successor
from veriplex.operators import boundary as B
from veriplex.operators import pack as K
from veriplex.operators import proof as P
from veriplex.operators.build import build_local
from veriplex.operators.logical import Bound, Range, RangeError
from veriplex.operators.node import EMPTY_ROOT, Node, NodeError, Value, block_id, parse
from veriplex.operators.reader import Need, Reader, aggregate_claimed, aggregate_verified, converge, diff_trees, range_page

# Fixed values: (level, key, hash as little-endian number), block ids and roots.
HASHES = [(0, "", 0x5FFC1791), (0, "642f706f73742f31", 0x977F5E67), (1, "642f706f73742f31", 0x58D96159), (3, "652f666f6c6c6f77732f78", 0xD4CB42CA)]
IDS = [(0, "", "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), (1, "76616c7565", "89e4038bf5c0681ed10512a02b00493e0473e1e09e7d8914d4cb00c66cfd1507")]
ROOTS = {0: "0e62cdb5899d1d564a37f48c0a24df66763daa95d5ac133692c7794de87e578c", 1: "dfeadcd30d8b84e51f9942988a8944aac029e4d32ed10d4ddc43e1b53cb3c3b7",
         5000: "0f6d642dee8f8a08302a9ae46476c9678aa9cbcf1a4b0669f01ba3057917b45d"}
PARITY_7 = ("e03599927b961755aca3580e6b000a3ee04547d39c6bbcd4fd939b207aec18df", 342)


def test_blake3_known_values():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 16384]
    assert blake3_many([b"q" * n for n in sizes]) == [blake3(b"q" * n) for n in sizes]


@pytest.mark.parametrize(("level", "key", "want"), HASHES)
def test_split_hash(level, key, want):
    assert B.split_hash(level, bytes.fromhex(key)) == want


def test_block_ids_and_roots():
    for kind, body, want in IDS:
        assert block_id(kind, bytes.fromhex(body)).hex() == want
    assert EMPTY_ROOT.hex() == ROOTS[0]
    for n in (1, 5000):
        assert build_local(dataset(1, n))[0].hex() == ROOTS[n]


def test_field_and_parity():
    assert all(div(int(MUL[a, b]), b) == a for a in range(256) for b in (1, 2, 77, 255))
    states = [bytes([i % 2]) + bytes(b * (i + 3) % 256 for b in range(1 + 8 * i * i + 8 * i)) for i in range(7)]
    parity = B.encode_group(states)
    assert (block_id(4, parity[0]).hex(), max(map(len, parity))) == PARITY_7
    random.seed(1)
    for _ in range(40):
        have = [B.symbol(s) for s in states] + parity
        for i in random.sample(range(15), 8):
            have[i] = None
        assert B.repair_group(7, have, 10_000) == states
    with pytest.raises(RsError, match="NotEnough"):
        B.repair_group(7, [None] * 9 + parity[:6], 10_000)
    with pytest.raises(RsError, match="MemberTooLong"):
        B.repair_group(7, [None] * 7 + parity, 5)
    assert B.update_group(parity, 3, states[3], b"changed") == B.encode_group([*states[:3], b"changed", *states[4:]])


def test_group_sizes_rules():
    assert B.group_sizes([]) == []
    assert B.group_sizes([2**32 - 1] * 36) == [36]
    assert B.group_sizes([0] * 21) == [21]
    assert B.group_sizes([0] * 30) == [30]
    assert B.group_sizes([0] * 42) == [21, 21]
    assert sum(B.group_sizes([7] * 200)) == 200


def test_node_round_trip_and_mutations():
    root, blocks = build_local(dataset(3, 400))
    nodes = [body for kind, body in blocks.values() if kind == 1]
    for body in nodes:
        node = parse(body)
        assert node.encode() == body
        B.check_node(node)
    random.seed(2)
    for _ in range(3000):
        body = bytearray(random.choice(nodes))
        for _ in range(random.randint(1, 3)):
            body[random.randrange(len(body))] = random.randrange(256)
        try:
            assert parse(bytes(body)).encode() == bytes(body)
        except NodeError:
            pass
    for cut in (0, 5, 27, 28, 100):
        with pytest.raises(NodeError):
            parse(nodes[0][:cut])


def test_value_choice_is_by_length():
    assert not Value.of(b"x" * 1024).is_ref and Value.of(b"x" * 1025).is_ref
    bad = Node(0, [b"k"], [Value(None, b"c" * 32, 1025)])
    parse(bad.encode())
    with pytest.raises(Exception, match="ValueTooShort"):
        Node(0, [b"k"], [Value(None, b"c" * 32, 1024)]).encode()


def test_fraud_and_wrong_levels():
    root, blocks = build_local(dataset(5, 300))
    top = parse(blocks[root][1])
    child = blocks[top.children[0][0]][1]
    assert not B.fraud(blocks[root][1], child)
    cid, count, size = top.children[0]
    top.children[0] = (cid, count + 1, size)
    assert B.fraud(top.encode(), child)
    assert not B.fraud(b"junk", child) and not B.fraud(child, b"")


def test_reader_against_a_dictionary():
    rows = dict(dataset(7, 1500))
    root, blocks = build_local(sorted(rows.items()))
    store = {c: b for c, (_, b) in blocks.items()}
    reader = Reader(store, root)
    keys = sorted(rows)
    random.seed(3)
    for key in random.sample(keys, 40):
        assert reader.get(key).inline == rows[key] and reader.get(key + b"\0") is None
    for _ in range(120):
        pick = lambda: random.choice([Bound(), Bound.including(random.choice(keys)), Bound.excluding(random.choice(keys)), Bound.including(random.choice(keys) + b"\0")])
        r = Range(pick(), pick(), random.random() < 0.5, random.choice([None, None, random.choice(keys)]), random.choice([1, 7, 5000]), random.choice([1, 900, 10**9]))
        want = [k for k in (reversed(keys) if r.reverse else keys) if r.holds(k)]
        page = range_page(store, root, r)
        used, served = 0, []
        for k in want[:r.max_entries]:
            used += len(k) + len(rows[k])
            if served and used > r.max_bytes:
                break
            served.append(k)
        assert [k for k, _ in page.entries] == served
        assert page.finished == (len(served) == len(want) and len(served) < r.max_entries) or r.is_empty()
        flat = Range(r.lo, r.hi)
        inside = [k for k in keys if flat.holds(k)]
        total = len(inside), sum(len(k) + len(rows[k]) for k in inside)
        assert aggregate_claimed(store, root, flat) == aggregate_verified(store, root, flat) == total
    with pytest.raises(RangeError):
        range_page(store, root, Range(max_entries=0))


def test_cold_store_converges_and_names_what_it_lacks():
    rows = dataset(9, 1200)
    root, blocks = build_local(rows)
    store = {c: b for c, (_, b) in blocks.items()}
    page, rounds = converge(lambda held: range_page(held, root, Range(max_entries=30)), lambda need: {c: store[c] for c in need}, {})
    assert [k for k, _ in page.entries] == [k for k, _ in rows[:30]] and rounds < 8
    with pytest.raises(Need) as e:
        Reader({}, root).get(rows[0][0])
    assert e.value.cids == [root]
    assert range_page({}, root, Range()).end == "Blocked"


def test_proofs_answer_only_what_they_prove():
    rows = dataset(1, 1000)
    root, blocks = build_local(rows)
    store = {c: b for c, (_, b) in blocks.items()}
    key, value = rows[500]
    data = P.prove(store, root, key).encode()
    assert P.verify_bytes(root, key, data)[2] == value
    assert P.verify_bytes(root, b"", P.prove(store, root, b"").encode())[0] == "Absent" and len(P.prove(store, root, b"").nodes) == 1
    for wrong, kind in ((P.Proof(P.Proof.decode(data).nodes[:-1]), "Incomplete"), (P.Proof(P.Proof.decode(data).nodes[::-1]), "WrongRoot"), (P.Proof([]), "Incomplete"),
                        (P.Proof(P.Proof.decode(data).nodes, b"x"), "Extra")):
        with pytest.raises(P.ProofError) as e:
            P.verify(root, key, wrong)
        assert e.value.kind == kind
    with pytest.raises(P.ProofError):
        P.verify_bytes(root, key, data + b"\0")
    r = Range(max_entries=25)
    page = P.verify_range_bytes(root, r, P.prove_range(store, root, r).encode())
    assert [k for k, _ in page.entries] == [k for k, _ in rows[:25]]
    part = Range(Bound.including(rows[100][0]), Bound.excluding(rows[700][0]))
    assert P.verify_aggregate(root, part, P.prove_aggregate(store, root, part)) == aggregate_verified(store, root, part)
    random.seed(4)
    for _ in range(300):
        bad = bytearray(data)
        bad[random.randrange(len(bad))] ^= 1 << random.randrange(8)
        try:
            assert P.verify_bytes(root, key, bytes(bad))[2] == value
        except P.ProofError:
            pass


def test_diff_of_trees():
    a = dict(dataset(1, 900))
    b = dict(a)
    keys = sorted(a)
    for k in keys[100:110]:
        del b[k]
    b[keys[500]] = b"changed"
    b[keys[700] + b"\1"] = b"new"
    (ra, xa), (rb, xb) = build_local(sorted(a.items())), build_local(sorted(b.items()))
    store = {c: body for c, (_, body) in (xa | xb).items()}
    found, fresh = diff_trees(store, ra, rb)
    assert [k for k, _, _ in found] == sorted([*keys[100:110], keys[500], keys[700] + b"\1"])
    nodes = lambda x: {c for c, (kind, _) in x.items() if kind == 1}
    assert set(fresh) == nodes(xb) - nodes(xa)
    assert diff_trees(store, ra, ra) == ([], [])


def test_packs():
    blocks = [(1, b"node"), (0, b""), (0, b"value"), (0, b"value")]
    data = K.build(blocks)
    assert data == K.build(blocks[::-1]) and len(K.members(data)) == 3
    assert K.build([(0, b"")]).hex() == "504b303101000000000000"
    for bad, kind in ((b"PK02" + data[4:], "NotAPack"), (data + b"\0", "TrailingBytes"), (data[:-1], "Truncated"), (b"PK01\0\0", "Empty"), (b"PK01\xff\xff", "CountDoesNotFit")):
        with pytest.raises(K.PackError) as e:
            K.members(bad)
        assert e.value.kind == kind
    assert not K.well_formed(data, K.Policy(packable=lambda k: k == 0))
    with pytest.raises(K.PackError, match="TooLarge"):
        K.build([(0, b"x" * (1 << 20))])


def test_packs_hash_members_together(monkeypatch):
    called, ids = [], K.block_ids
    monkeypatch.setattr(K, "block_ids", lambda blocks: (called.append(len(blocks)), ids(blocks))[1])
    packs = [K.build([(0, b"%d %d" % (n, i)) for i in range(300)]) for n in range(4)]
    called.clear()
    apart = [K.members(data) for data in packs]
    assert len(called) <= 4 * 10 and sum(called) == 1200  # not a call a member
    called.clear()
    assert K.members_of(packs) == sum(apart, []) and called == [1200]
    # Of faults by lengths or kinds and faults by order the first stands, and little behind it is hashed.
    rows = [data for _, data in sorted((block_id(1, b), b) for b in (b"a", b"b", b"c", b"d"))]
    pack = lambda *members: K.MAGIC + len(members).to_bytes(2, "little") + b"".join(bytes([k]) + len(b).to_bytes(4, "little") + b for k, b in members)
    early, late = pack((1, rows[1]), (1, rows[0]), (9, rows[2])), pack((1, rows[0]), (9, rows[1]), (1, rows[0]))
    policy = K.Policy(packable=lambda k: k == 1)
    for walk in (K.members, lambda data, policy: K.members_of([data], policy)):
        for data, want in ((early, ("OutOfOrder", 1)), (late, ("KindNotPackable", 1)), (pack((1, rows[0]), (1, rows[0])), ("OutOfOrder", 1))):
            with pytest.raises(K.PackError) as e:
                walk(data, policy)
            assert (e.value.kind, e.value.member) == want
    called.clear()
    with pytest.raises(K.PackError, match="OutOfOrder"):
        K.members(pack(*[(1, b) for b in reversed(rows)] * 50))
    assert sum(called) <= 4


def test_hashes_and_parity_by_the_definition():
    """Messages of mixed lengths in one call, over the seams of lanes and batches; parity byte by byte."""
    random.seed(3)
    sizes = [0, 1, 64, 65, 1024, 1025, 2048, 3073, 40_000, 262_145, *(random.randrange(6000) for _ in range(60))]
    messages = [random.randbytes(n) for n in sizes]
    assert blake3_many(messages) == [blake3(m) for m in messages]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(blake3_module, "LANES", 3)
        m.setattr(blake3_module, "BATCH", 4096)
        assert blake3_many(messages) == [blake3(m) for m in messages]
    data = [random.randbytes(n) for n in (0, 5, 300, 17)]
    width = range(300)
    at = lambda s, i: s[i] if i < len(s) else 0
    for r, got in enumerate(encode(data, 8)):
        want = bytearray(300)
        for i in width:
            for c, s in enumerate(data):
                want[i] ^= int(MUL[coefficient(r, c), at(s, i)])
        assert got == bytes(want).rstrip(b"\0")


def test_parity_of_nodes_is_hashed_together(monkeypatch):
    called, ids = [], B.block_ids
    nodes = [Node(0, [b"k%d%02d" % (n, i) for i in range(40)], [Value.of(b"%d" % i * 1100) for i in range(40)]) for n in range(5)]
    apart = [B.parity_blocks(n, lambda i: b"%d" % i * 1100) for n in nodes]
    monkeypatch.setattr(B, "block_ids", lambda blocks: (called.append(len(blocks)), ids(blocks))[1])
    assert B.parity_of(nodes, [lambda i: b"%d" % i * 1100] * 5) == apart and called == [sum(map(len, apart))]


def test_successor():
    assert successor(b"a\xff") == b"b" and successor(b"\xff") is None and successor(b"") is None


def test_apply_equals_rebuild_and_reads_little():
    from veriplex.operators.apply import apply_cold, apply_edits

    random.seed(11)
    rows = dict(dataset(4, 300))
    root, old = build_local(sorted(rows.items()))
    ids = lambda blocks: {c for c, (kind, _) in blocks.items() if kind == 1}
    for batch in range(14):
        keys, edits = sorted(rows), {}
        for _ in range(random.choice([1, 3, 20])):
            key, x = random.choice(keys) if keys else b"first", random.random()
            if x < 0.3:
                edits[key + bytes([random.randrange(256)])] = bytes(random.randrange(400))
            elif x < 0.4:
                edits[key] = b"r" * random.randrange(1100, 6000)
            elif x < 0.5:
                edits[key] = rows.get(key, b"")
            elif x < 0.6:
                edits[key + b"zz"] = None
            else:
                edits[key] = None
        if batch == 10:
            edits = dict.fromkeys(keys)
        new = {k: v for k, v in {**rows, **edits}.items() if v is not None}
        want, blocks = build_local(sorted(new.items()))
        got = apply_edits({c: b for c, (_, b) in old.items()}, root, sorted(edits.items()))
        assert got.root == want and got.replaced == ids(old) - ids(blocks)
        assert set(blocks) - set(old) <= set(got.blocks) <= set(blocks)
        rows, root, old = new, want, blocks
    rows = dict(dataset(6, 2500))
    root, old = build_local(sorted(rows.items()))
    asked = set()

    def fetch(need):
        asked.update(need)
        return {c: old[c][1] for c in need}

    key = sorted(rows)[1000]
    got, _ = apply_cold(fetch, root, [(key, b"changed")])
    assert got.root == build_local(sorted((rows | {key: b"changed"}).items()))[0] and len(asked) < len(old) / 2
    with pytest.raises(Exception, match="NotSorted"):
        apply_edits({}, root, [(b"b", b""), (b"a", b"")])


def test_cursor_walks_both_ways():
    from veriplex.operators.cursor import Cursor, LevelCursor

    rows = dataset(2, 900)
    root, blocks = build_local(rows)
    store = {c: b for c, (_, b) in blocks.items()}
    reader, keys = Reader(store, root), [k for k, _ in rows]
    at, seen = Cursor(reader), []
    assert at.peek() is None and at.is_first_leaf()
    while at.next():
        seen.append(at.peek()[0])
    assert seen == keys and at.peek() is None and not at.next()
    back = []
    while at.prev():
        back.append(at.peek()[0])
    assert back == keys[::-1] and not at.prev() and at.next() and at.peek()[0] == keys[0]
    for i in (0, 17, 450, 898):
        assert Cursor.seek(reader, keys[i]).peek()[0] == keys[i] and Cursor.seek(reader, keys[i] + b"\0").peek()[0] == keys[i + 1]
    assert Cursor.seek(reader, b"\xff").peek() is None and Cursor.seek_last(reader).peek()[0] == keys[-1]
    leaf = LevelCursor(reader)
    firsts = [leaf.held.node.keys[0]]
    while (follows := leaf.next_min_key()) is not None:
        assert leaf.step(1) and leaf.held.node.keys[0] == follows
        firsts.append(follows)
    assert not leaf.step(1) and firsts == sorted(firsts) and firsts[0] == keys[0]
    at = Cursor.seek(reader, keys[0])
    assert at.leaf_min_key() == keys[0] and at.at_leaf_start()
    empty, none = build_local([])
    assert not Cursor(Reader({empty: none[empty][1]}, empty)).next() and Cursor.seek_last(Reader({empty: none[empty][1]}, empty)).peek() is None


def test_cursor_that_lacks_a_block_does_not_move():
    from veriplex.operators.cursor import Cursor

    rows = dataset(2, 900)
    root, blocks = build_local(rows)
    store = {c: b for c, (_, b) in blocks.items()}
    at = Cursor.seek(Reader(store, root), rows[0][0])
    while not at.at_leaf_end():
        at.next()
    top = at.peek()
    gone = Cursor.seek(Reader(store, root), at.next_min_key()).leaf()
    body = store.pop(gone)
    with pytest.raises(Need):
        at.next()
    assert at.peek() == top
    store[gone] = body
    assert at.next() and at.peek()[0] > top[0]


def test_diff_by_pages_over_a_cold_store():
    from veriplex.operators.diff import diff_cold, diff_page
    from veriplex.operators.logical import DiffError

    a = dict(dataset(1, 900))
    keys = sorted(a)
    random.seed(5)
    for size in (1, 12, 300, 900):
        b = {k: v for k, v in a.items()}
        for k in random.sample(keys, size):
            x = random.random()
            if x < 0.4:
                del b[k]
            elif x < 0.7:
                b[k] = b"changed"
            else:
                b[k + b"\1"] = b"n" * random.choice([3, 2000])
        (ra, xa), (rb, xb) = build_local(sorted(a.items())), build_local(sorted(b.items()))
        store = {c: body for c, (_, body) in (xa | xb).items()}
        want = [k for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
        nodes = lambda x: {c for c, (kind, _) in x.items() if kind == 1}
        page = diff_page(store, ra, rb, Range(max_entries=0, max_bytes=0))
        assert [k for k, _, _ in page.changes] == want and set(page.new_blocks) == nodes(xb) - nodes(xa) and page.next is None
        asked = []
        cold, _ = diff_cold(lambda need: asked.append(need) or {c: store[c] for c in need}, ra, rb, Range(max_entries=5))
        assert [k for k, _, _ in cold] == want and max(map(len, asked)) <= 64
        assert {c for n in asked for c in n} <= nodes(xa) ^ nodes(xb)
        part = Range(Bound.including(keys[200]), Bound.excluding(keys[400]), max_entries=3)
        found, _ = diff_cold(lambda need: {c: store[c] for c in need}, ra, rb, part)
        assert [k for k, _, _ in found] == [k for k in want if part.holds(k)]
        assert diff_page({}, ra, ra).changes == [] and diff_page({}, ra, rb).need == [ra, rb]
        token = diff_page(store, ra, rb, Range(max_entries=1)).next
        if token:
            with pytest.raises(DiffError, match="RootsChanged"):
                diff_page(store, rb, ra, resume=token)
    empty, none = build_local([])
    store |= {empty: none[empty][1]}
    assert len(diff_page(store, empty, ra, Range(max_entries=0, max_bytes=0)).changes) == len(a)
    assert diff_page({empty: none[empty][1]}, empty, ra).changes == []


def test_parity_is_copied_or_corrected():
    from veriplex.operators.apply import apply_cold

    rows = {b"z/%04d" % i: bytes([i % 251]) * (1500 + i) for i in range(120)}
    root, old = build_local(sorted(rows.items()))
    asked = set()

    def fetch(need):
        asked.update(need)
        return {c: old[c][1] for c in need}

    got, _ = apply_cold(fetch, root, [(b"z/0050", b"other" * 400)])
    want, blocks = build_local(sorted((rows | {b"z/0050": b"other" * 400}).items()))
    assert got.root == want and set(blocks) - set(old) <= set(got.blocks) <= set(blocks)
    assert sum(old[c][0] == 0 for c in asked) == 1  # the old value alone; no other member of its group


def test_streaming_builder():
    from veriplex.operators.build import TreeBuilder, TreeError

    for rows in ([], dataset(1, 1), dataset(4, 1500), [(b"z/%04d" % i, b"x" * (900 + 40 * i)) for i in range(80)]):
        made, want = {}, build_local(rows)
        one = TreeBuilder(lambda cid, kind, body: made.update({cid: (kind, body)}))
        for k, v in rows:
            one.push_bytes(k, v)
        root, parity = one.finish_with_parity()
        assert root == want[0] and made | {c: (2, b) for c, b in parity} == {c: (k if k < 2 else 2, b) for c, (k, b) in want[1].items()}
        with pytest.raises(TreeError, match="Poisoned"):
            one.push_bytes(b"\xff" * 9, b"")
    one = TreeBuilder(lambda *_: None)
    one.push_bytes(b"b", b"1")
    with pytest.raises(TreeError, match="NotSorted"):
        one.push_bytes(b"b", b"1")
    with pytest.raises(TreeError, match="MissingMember"):
        one.push(b"c", Value.of(b"x" * 2000))
    one.see(Value.of(b"x" * 2000).cid, b"x" * 2000)
    one.push(b"c", Value.of(b"x" * 2000))
    assert one.finish() == build_local([(b"b", b"1"), (b"c", b"x" * 2000)])[0]


def test_claimed_is_not_verified():
    from veriplex.operators.reader import Claimed, Verified

    root, blocks = build_local(dataset(3, 200))
    store = {c: b for c, (_, b) in blocks.items()}
    assert isinstance(aggregate_claimed(store, root), Claimed) and isinstance(aggregate_verified(store, root), Verified)
    with pytest.raises(TypeError):
        Verified((1, 2))
    assert isinstance(P.verify_aggregate(root, Range(), P.prove_aggregate(store, root)), Claimed)
