import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerlake.functions import codec, state, table_metadata, wire


@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    assert wire.read_varint(wire.varint(n), 0) == (n, len(wire.varint(n)))


@given(st.integers(-(2**63), 2**63 - 1))
def test_zigzag(n):
    assert wire.unzigzag(wire.zigzag(n)) == n


def test_varint_that_ends_early_or_is_too_long():
    with pytest.raises(ValueError):
        wire.read_varint(b"\x80", 0)
    with pytest.raises(ValueError):
        wire.read_varint(b"\xff" * 11, 0)


def _fill(kind, k):
    if kind == "map":
        return {"a": "b", "": "é"}
    if kind in ("int", "long", "zz", "ref"):
        return -5 - k
    return {"bool": True, "str": f"s{k}é", "bytes": b"\x00\xff", "uuid": f"00000000-0000-0000-0000-{k:012d}"}.get(kind)


def _example(name, k=1):
    if name == "Summary":
        return {"operation": "replace", "added-records": "7", "x": "y", "total-records": "0x"}
    if name in codec.UNIONS:
        kind = list(codec.UNIONS[name].values())[k % len(codec.UNIONS[name])]
        return {"kind": kind, **_example(kind)}
    out = {}
    for j, (key, kind) in codec.MESSAGES[name].items():
        one = lambda i, t=kind.lstrip("*"): _fill(t, i) if _fill(t, i) is not None else _example(t, i)
        out[key] = [one(j), one(j + 1)] if kind[0] == "*" else one(j)
    return out


@pytest.mark.parametrize("name", [*codec.MESSAGES, "Summary"])
def test_round_trip(name):
    m = _example(name)
    assert codec.decode(name, codec.encode(name, m)) == m


@pytest.mark.parametrize("name", list(codec.MESSAGES))
def test_unknown_fields_are_skipped(name):
    m = _example(name)
    more = wire.field(99, 2, b"abc") + wire.field(98, 0, 7) + wire.field(97, 1, 7)
    assert codec.decode(name, more + codec.encode(name, m) + more) == m


def test_zero_counts_are_not_written():
    assert codec.encode("Summary", {"operation": "append", "added-records": "0"}) == b""


def test_ids_as_varints_are_understood():
    b = wire.field(1, 0, 77) + wire.field(2, 0, 1) + wire.field(2, 2, b"\x02\x03")
    assert codec.decode("Refs", b) == {"snapshot_id": 77, "pool_indices": [1, 2, 3]}


def test_unknown_action_goes_back_as_it_came():
    raw = wire.field(42, 2, b"xyz")
    a = codec.decode("Action", raw)
    assert a["kind"] == "unknown" and codec.encode("Action", a) == raw
    assert state.State().holds(a) and state.State().do(a) is None


def test_seal():
    r = codec.encode("Transaction", _example("Transaction") | {"sealed": False})
    assert codec.decode("Transaction", codec.seal(r))["sealed"] and codec.seal(codec.seal(r), False) == r


@pytest.mark.parametrize("bad", [b"LCAX\0\0\0\1\0", b"LCAT\0\0\0\2\0", b"LCAT\0\0\0\1\5ab", b"LCAT\0\0\0\1\0\5ab"])
def test_bad_files(bad):
    with pytest.raises(ValueError):
        codec.split_file(bad)


BASE = {"location": "l", "properties": {"a": "1", "b": "2"}, "last-updated-ms": 100, "last-sequence-number": 0, "schemas": [{"schema-id": 0}], "current-schema-id": 0, "snapshots": [], "refs": {}}


def test_difference_and_application():
    new = json.loads(json.dumps(BASE)) | {"location": "m", "properties": {"a": "9", "c": "3"}, "schemas": [{"schema-id": 0}, {"schema-id": 1}], "current-schema-id": 1, "last-updated-ms": 170, "last-sequence-number": 2, "last-column-id": 4}
    new["snapshots"] = [
        {"snapshot-id": 5, "sequence-number": 1, "timestamp-ms": 150, "manifest-list": "inline://5", "summary": {"operation": "append"}, "schema-id": 0},
        {"snapshot-id": 6, "sequence-number": 2, "timestamp-ms": 170, "manifest-list": "p/x", "summary": {"operation": "delete"}, "schema-id": 1, "parent-snapshot-id": 5},
    ]
    new["refs"] = {"main": {"snapshot-id": 6, "type": "branch"}, "t": {"snapshot-id": 5, "type": "tag", "max-ref-age-ms": 9}}
    d = codec.decode("Delta", codec.encode("Delta", {"updates": table_metadata.difference(BASE, new, "p/")}))["updates"]
    got = table_metadata.apply(BASE, d, "p/")
    assert got == new | {"current-snapshot-id": 6}
    back = table_metadata.apply(got, table_metadata.difference(got, BASE | {"schemas": new["schemas"]}))
    assert back["snapshots"] == [] and back["refs"] == {} and back["properties"] == BASE["properties"]


def test_changed_statistics_need_the_whole():
    assert table_metadata.difference(BASE, BASE | {"statistics": [1]}) is None


def test_manifests_need_their_snapshot():
    with pytest.raises(ValueError):
        table_metadata.check_order([{"kind": "add_manifest", "snapshot_id": 1}])


def _table():
    s = state.State()
    s.tables[1] = state.Table(0, "t", 1, None, b"{}", "p/")
    return s, s.tables[1]


def _snap(i, parent=None):
    return {"kind": "add_snapshot", "snapshot_id": i, "manifest_list_suffix": "", "summary": {}, "timestamp_delta_ms": 1, "parent_snapshot_id": parent}


def _add(i, path):
    return {"kind": "add_manifest", "snapshot_id": i, "manifest": {"path": path}}


def test_pool_carries_forward_and_collects():
    s, t = _table()
    s.patch(t, [_snap(1), _add(1, "a"), _add(1, "ba")])
    s.patch(t, [_snap(2, 1), _add(2, "c"), {"kind": "remove_manifest", "snapshot_id": 2, "path": "a"}])
    s.patch(t, [_snap(3, 2)])
    assert t.refs == {1: ["p/a", "p/ba"], 2: ["p/ba", "p/c"], 3: ["p/ba", "p/c"]}  # `a` is not taken for the end of `ba`
    s.patch(t, [{"kind": "remove_snapshots", "snapshot_ids": [1]}])
    assert list(t.pool) == ["p/ba", "p/c"]
    again = state.from_checkpoint(state.to_checkpoint(s)).tables[1]
    assert again.refs == t.refs and list(again.pool) == list(t.pool)
