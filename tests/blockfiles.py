"""Writers of small block-compressed files, their indexes, and binary variants, for tests."""

import struct
import zlib


def member(raw):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(raw) + body.flush()
    head = struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(raw), len(raw))


END_OF_FILE = member(b"")


def blocks(raw, size):
    """(file bytes, place of a byte as virtual offset)."""
    out, starts = b"", []
    for i in range(0, len(raw), size):
        starts.append(len(out))
        out += member(raw[i : i + size])

    def place(i):
        if i == len(raw) and i % size == 0:
            return len(out) << 16
        return (starts[i // size] << 16) + i % size

    return out + END_OF_FILE, place


def window_bin(start, stop, shift, depth):
    """The smallest bin of [start, stop) from zero."""
    last, s, t = stop - 1, shift, ((1 << depth * 3) - 1) // 7
    for level in range(depth, 0, -1):
        if start >> s == last >> s:
            return t + (start >> s)
        s += 3
        t -= 1 << (level - 1) * 3
    return 0


def index(kind, names, records, shift=14, depth=5):
    """Bytes of an index over (ref number, start from zero, stop, first place, end place)."""
    names_raw = b"".join(n.encode() + b"\0" for n in names)
    settings = struct.pack("<6i", 2, 1, 2, 0, ord("#"), 0)
    if kind == "tbi":
        out = b"TBI\1" + struct.pack("<i", len(names)) + settings + struct.pack("<i", len(names_raw)) + names_raw
    else:
        aux = settings + struct.pack("<i", len(names_raw)) + names_raw if kind == "csi" else b""
        out = b"CSI\1" + struct.pack("<3i", shift, depth, len(aux)) + aux + struct.pack("<i", len(names))
    for ref in range(len(names)):
        own = [r for r in records if r[0] == ref]
        bins, linear = {}, {}
        for _, start, stop, a, z in own:
            b = window_bin(start, stop, shift, depth)
            chunks = bins.setdefault(b, [])
            if chunks and chunks[-1][1] == a:
                chunks[-1] = chunks[-1][0], z
            else:
                chunks.append((a, z))
            for w in range(start >> shift, (stop - 1 >> shift) + 1):
                linear[w] = min(linear.get(w, a), a)
        out += struct.pack("<i", len(bins) + 1)
        for b, chunks in bins.items():
            low = min(c[0] for c in chunks)
            out += struct.pack("<I", b) + (b"" if kind == "tbi" else struct.pack("<Q", low)) + struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        summary = ((1 << 3 * (depth + 1)) - 1) // 7 + 1
        out += struct.pack("<I", summary) + (b"" if kind == "tbi" else struct.pack("<Q", 0)) + struct.pack("<i", 2) + struct.pack("<4Q", 0, 0, len(own), 0)
        if kind == "tbi":
            n = max(linear, default=-1) + 1
            filled, last = [], 0
            for w in range(n):
                last = linear.get(w, last)
                filled.append(last)
            out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
    return blocks(out, 60000)[0]


def write_text(path, text, size, kind=None, **how):
    """A block-compressed text file, with an index of its records if wanted."""
    raw = text.encode()
    packed, place = blocks(raw, size)
    path.write_bytes(packed)
    records, names, at = [], [], 0
    for line in raw.split(b"\n")[:-1]:
        if not line.startswith(b"#"):
            f = line.decode().split("\t")
            if f[0] not in names:
                names.append(f[0])
            start = int(f[1]) - 1
            records.append((names.index(f[0]), start, start + len(f[3]), place(at), place(at + len(line) + 1)))
        at += len(line) + 1
    if kind:
        (path.parent / f"{path.name}.{kind}").write_bytes(index(kind, names, records, **how))


# ---------------------------------------------------------------- binary variants


def typed(values, kind):
    n, code = len(values), {"i1": 1, "i2": 2, "i4": 3, "f4": 5, "S1": 7}[kind]
    head = bytes([min(n, 15) << 4 | code]) + (typed([n], "i4") if n >= 15 else b"")
    return head + b"".join(v if kind == "S1" else struct.pack({"i1": "<b", "i2": "<h", "i4": "<i", "f4": "<f"}[kind], v) for v in values)


def text_of(s):
    return typed([bytes([b]) for b in s.encode()], "S1")


def integers(values):
    known = [v for v in values if v is not None]
    kind = "i1" if all(-120 <= v < 128 for v in known) else "i2" if all(-32000 <= v < 32768 for v in known) else "i4"
    missing = {"i1": -128, "i2": -32768, "i4": -(1 << 31)}[kind]
    return [missing if v is None else v for v in values], kind, missing + 1


def write_binary(path, text, size, indexed=False):
    """The lines of a variant text as a binary file; GT and integer FORMAT entries."""
    lines = text.split("\n")[:-1]
    head = [line for line in lines if line.startswith("#")]
    rows = [line.split("\t") for line in lines if not line.startswith("#")]
    contigs = list(dict.fromkeys(r[0] for r in rows))
    keys = list(dict.fromkeys([k.split("=")[0] for r in rows for k in r[7].split(";") if k != "."] + [k for r in rows for k in r[8].split(":")]))
    extra = [f"##contig=<ID={c},length=5000000>" for c in contigs] + ['##FILTER=<ID=PASS,Description="x">'] + [f'##INFO=<ID={k},Number=.,Type=String,Description="x, ID=y">' for k in keys]
    header = "\n".join([*[h for h in head[:-1] if not h.startswith("##contig")], *extra, head[-1], ""]).encode() + b"\0"
    strings = ["PASS", *keys]
    raw = b"BCF\2\2" + struct.pack("<I", len(header)) + header
    spans = []
    for r in rows:
        infos = [k for k in r[7].split(";") if k != "."]
        alts = [] if r[4] == "." else r[4].split(",")
        shared = struct.pack("<iiifII", contigs.index(r[0]), int(r[1]) - 1, len(r[3]), 0.0, (1 + len(alts)) << 16 | len(infos), len(r[8].split(":")) << 24 | len(r) - 9)
        shared += text_of("" if r[2] == "." else r[2]) + b"".join(map(text_of, [r[3], *alts])) + typed([], "i1")[:1].replace(b"\x01", b"\x00")
        for k in infos:
            name, _, v = k.partition("=")
            shared += typed([strings.index(name)], "i1")
            parts = v.split(",")
            if not v:
                shared += b"\x00"
            elif all(p.lstrip("-").isdigit() for p in parts):
                shared += typed(*integers([int(p) for p in parts])[:2])
            else:
                shared += text_of(v)
        own = b""
        for i, name in enumerate(r[8].split(":")):
            cells = [c.split(":")[i] for c in r[9:]]
            own += typed([strings.index(name)], "i1")
            if name == "GT":
                values = []
                for c in cells:
                    parts = c.replace("|", " |").replace("/", " /").split(" ")
                    values.append([(0 if p.strip("|/") == "." else (int(p.strip("|/")) + 1) << 1) | p.startswith("|") for p in parts])
            else:
                values = [[None if p == "." else int(p) for p in c.split(",")] for c in cells]
            width = max(map(len, values))
            flat, kind, closed = integers([v for vs in values for v in [*vs, *["end"] * (width - len(vs))] if v != "end"])
            it = iter(flat)
            whole = [next(it) if j < len(vs) else closed for vs in values for j in range(width)]
            own += bytes([width << 4 | {"i1": 1, "i2": 2, "i4": 3}[kind]]) + typed(whole, kind)[1 if len(whole) < 15 else 6 :]
        spans.append((contigs.index(r[0]), int(r[1]) - 1, int(r[1]) - 1 + len(r[3]), len(raw)))
        raw += struct.pack("<II", len(shared), len(own)) + shared + own
    packed, place = blocks(raw, size)
    path.write_bytes(packed)
    if indexed:
        ends = [s[3] for s in spans[1:]] + [len(raw)]
        (path.parent / f"{path.name}.csi").write_bytes(index("bcf", contigs, [(*s[:3], place(s[3]), place(e)) for s, e in zip(spans, ends)]))
