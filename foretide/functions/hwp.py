"""Text of binary word-processor documents: a compound file of streams, whose body is a list of tagged records."""

from __future__ import annotations

import struct
import zlib

_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
PARAGRAPH_TEXT = 67
#: Control codes that take eight characters in a paragraph's text; those not listed and below 32 take one.
WIDE_CONTROLS = {1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23}


def streams(raw: bytes) -> dict[str, bytes]:
    """Every stream of a compound file by its path."""
    if raw[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("not a compound file")
    sector, mini = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    directory, cutoff, first_mini = struct.unpack_from("<I", raw, 48)[0], struct.unpack_from("<I", raw, 56)[0], struct.unpack_from("<I", raw, 60)[0]
    part = lambda i: raw[(i + 1) * sector : (i + 2) * sector]
    words = lambda b: struct.unpack(f"<{len(b) // 4}I", b)
    tables, more = [x for x in struct.unpack_from("<109I", raw, 76) if x < _END], struct.unpack_from("<I", raw, 68)[0]
    while more < _END:
        *own, more = words(part(more))
        tables += [x for x in own if x < _END]
    nexts = [x for t in tables for x in words(part(t))]

    def chain(start: int, table) -> list[int]:
        out = []
        while start < _END and len(out) <= len(table):
            out.append(start)
            start = table[start] if start < len(table) else _END
        return out

    read = lambda start: b"".join(part(i) for i in chain(start, nexts))
    entries = read(directory)
    fields = []
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        name = e[: max(struct.unpack_from("<H", e, 64)[0] - 2, 0)].decode("utf-16-le", "replace")
        fields.append((name, e[66], *struct.unpack_from("<III", e, 68), struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0]))
    small, mini_next = read(fields[0][5]), words(read(first_mini)) if first_mini < _END else ()
    out: dict[str, bytes] = {}
    todo = [("", fields[0][4])]
    while todo:
        path, i = todo.pop()
        if i >= len(fields):
            continue
        name, kind, left, right, child, start, size = fields[i]
        todo += [(path, left), (path, right)]
        if kind == 1:
            todo.append((f"{path}{name}/", child))
        elif kind == 2 and size < cutoff:
            out[path + name] = b"".join(small[j * mini : (j + 1) * mini] for j in chain(start, mini_next))[:size]
        elif kind == 2:
            out[path + name] = read(start)[:size]
    return out


def records(body: bytes):
    """(tag, level, payload) of each record."""
    at = 0
    while at + 4 <= len(body):
        head = struct.unpack_from("<I", body, at)[0]
        tag, level, size, at = head & 0x3FF, head >> 10 & 0x3FF, head >> 20, at + 4
        if size == 0xFFF:
            size, at = struct.unpack_from("<I", body, at)[0], at + 4
        yield tag, level, body[at : at + size]
        at += size


def paragraph(payload: bytes) -> str:
    out, at = [], 0
    codes = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    while at < len(codes):
        c = codes[at]
        if c >= 32:
            run = at
            while at < len(codes) and codes[at] >= 32:
                at += 1
            out.append(payload[2 * run : 2 * at].decode("utf-16-le", "replace"))
            continue
        out.append("\t" if c == 9 else "\n" if c == 10 else "")
        at += 8 if c in WIDE_CONTROLS else 1
    return "".join(out)


def read_hwp5(raw: bytes) -> str:
    """Paragraphs of all body sections, in order."""
    parts = streams(raw)
    packed = bool(struct.unpack_from("<I", parts.get("FileHeader", b"").ljust(40, b"\0"), 36)[0] & 1)
    sections = sorted((n for n in parts if n.startswith("BodyText/Section")), key=lambda n: int(n[len("BodyText/Section") :]))
    out = []
    for n in sections:
        body = zlib.decompress(parts[n], -15) if packed else parts[n]
        out += [paragraph(p) for tag, _, p in records(body) if tag == PARAGRAPH_TEXT]
    return "\n".join(out)
