import struct
import zlib

import numpy as np
import pytest

from lattica.sources import biosignal as B
from lattica.sources import datasets as S


def gdf_file(x, fs, events, version=2.2, kind=3, low=-100.0, high=100.0):
    """x: whole numbers (channels, samples), a record a second."""
    n, per = len(x), int(fs)
    new = version >= 1.9
    head = bytearray(256)
    head[:8] = f"GDF {version:.2f}".ljust(8).encode()
    size = 256 * (n + 1)
    struct.pack_into("<H" if new else "<q", head, 184, size // 256 if new else size)
    struct.pack_into("<qII", head, 236, x.shape[1] // per, 1, 1)
    struct.pack_into("<H" if new else "<I", head, 252, n)
    names = b"".join(f"EEG{k}".ljust(16).encode() for k in range(n)) + b" " * 80 * n
    units = b" " * 6 * n + struct.pack("<H", 4275) * n if new else b"uV".ljust(8) * n
    whole = "<d" if new else "<q"
    limits = struct.pack("<d", low) * n + struct.pack("<d", high) * n + struct.pack(whole, -1000) * n + struct.pack(whole, 1000) * n
    rest = b"\0" * 80 * n + struct.pack("<I", per) * n + struct.pack("<I", kind) * n + b"\0" * 32 * n
    head = bytes(head) + names + units + limits + rest
    assert len(head) == size
    t = B.GDF_TYPES[kind]
    body = b"".join(x[c, s : s + per].astype(t).tobytes() for s in range(0, x.shape[1], per) for c in range(n))
    table = b""
    if events:
        table = b"\x01" + (len(events).to_bytes(3, "little") + struct.pack("<f", fs) if version >= 1.94 else b"\0\0\0" + struct.pack("<I", len(events)))
        table += np.array([p + 1 for p, _ in events], "<u4").tobytes() + np.array([c for _, c in events], "<u2").tobytes()
    return head + body + table


def mat_element(kind, data):
    if len(data) <= 4 and kind != 14:
        return struct.pack("<HH", kind, len(data)) + data.ljust(4, b"\0")
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_file(packed=True, **arrays):
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    kinds = {"f8": (6, 9), "u1": (9, 2), "i2": (10, 3)}
    for name, a in arrays.items():
        cls, kind = kinds[a.dtype.str[1:]]
        body = mat_element(6, struct.pack("<II", cls, 0)) + mat_element(5, np.array(a.shape, "<i4").tobytes()) + mat_element(1, name.encode()) + mat_element(kind, a.tobytes(order="F"))
        element = mat_element(14, body)
        out += struct.pack("<II", 15, len(z := zlib.compress(element))) + z if packed else element
    text = mat_element(6, struct.pack("<II", 4, 0)) + mat_element(5, np.array([1, 2], "<i4").tobytes()) + mat_element(1, b"note") + mat_element(16, b"hi")
    return out + mat_element(14, text)


@pytest.mark.parametrize("version,kind", [(2.2, 3), (1.25, 3), (1.25, 5), (2.2, 16)])
def test_gdf_values_and_events(version, kind):
    x = np.random.RandomState(1).randint(-1000, 1000, (3, 400))
    held = B.read_gdf(gdf_file(x, 100.0, [(10, 768), (5, 769)], version, kind))
    assert held["fs"] == 100.0 and held["names"] == ["EEG0", "EEG1", "EEG2"] and held["events"] == [(5, 769), (10, 768)]
    assert np.allclose(held["signal"], x / 10 * 1e-6)


def test_gdf_source(spark, tmp_path):
    x = np.random.RandomState(2).randint(-1000, 1000, (4, 1000))
    (tmp_path / "A01T.gdf").write_bytes(gdf_file(x, 100.0, [(0, 768), (100, 769), (300, 772), (700, 1023), (820, 771), (950, 770)]))
    (tmp_path / "A01E.gdf").write_bytes(gdf_file(x, 100.0, []))
    (tmp_path / "A02T.gdf").write_bytes(gdf_file(x, 100.0, [(0, 770)], 1.25))
    rows = S.load("gdf", spark, path=str(tmp_path), seconds=3.0, channels=3).orderBy("subject_id", "session", "trial_id").collect()
    assert [(r["subject_id"], r["session"], r["trial_id"], r["label"]) for r in rows] == [(1, "E", 0, None), (1, "E", 1, None), (1, "E", 2, None), (1, "T", 0, 0), (1, "T", 1, 3), (1, "T", 2, 2), (2, "T", 0, 1)]
    trial = np.array(rows[5]["signal"])
    assert trial.shape == (3, 300) and np.allclose(trial[:, :180], x[:3, 820:] / 10 * 1e-6) and (trial[:, 180:] == trial[:, [179]]).all()
    assert S.load("gdf", spark, path=str(tmp_path), subjects=[2]).count() == 1
    with pytest.raises(ValueError, match="GDF"):
        B.read_gdf(b"not one" * 100)


@pytest.mark.parametrize("packed", [True, False])
def test_mat_source(spark, tmp_path, packed):
    x = np.random.RandomState(3).normal(size=(5, 2, 30))
    (tmp_path / "A03T.mat").write_bytes(mat_file(packed, data=x, class_labels=np.array([[1, 2, 3, 4, 1]], "u1")))
    (tmp_path / "A04T.mat").write_bytes(mat_file(packed, X=x, y=np.array([[0], [1], [0], [1], [2]], "i2")))
    (tmp_path / "A05T.mat").write_bytes(mat_file(packed, data=np.concatenate([t.T for t in x]), labels=np.array([[1.0, 2, 2, 1, 4]])))
    rows = S.load("mat", spark, path=str(tmp_path)).orderBy("subject_id", "trial_id").collect()
    assert [r["label"] for r in rows] == [0, 1, 2, 3, 0, 0, 1, 0, 1, 2, 0, 1, 1, 0, 3]
    assert all(np.allclose(r["signal"], x[r["trial_id"]]) for r in rows)
    assert set(B.read_mat(mat_file(packed, data=x))) == {"data"}
