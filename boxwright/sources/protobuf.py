"""Fields of protobuf messages, and their numbers by the descriptors that a recording carries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: varints and length-delimited values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("a field is cut off")
            at += n
            yield key >> 3, data[at - n : at]
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"a field of kind {kind}")


def _all(data: bytes, number: int) -> list[bytes]:
    return [v for n, v in protobuf_fields(data) if n == number and isinstance(v, bytes)]


def message_types(descriptor_sets: Iterable[bytes]) -> dict[str, dict[str, tuple[int, str]]]:
    """Field name to (number, type name) of every message in these sets of file descriptors, by full name.

    The type name is empty for fields that aren't messages or enumerations.
    """
    found: dict[str, dict[str, tuple[int, str]]] = {}

    def add(scope: str, message: bytes) -> None:
        name = f"{scope}.{_all(message, 1)[0].decode()}" if scope else _all(message, 1)[0].decode()
        fields = found.setdefault(name, {})
        for field in _all(message, 2):
            values = dict(protobuf_fields(field))
            kind = bytes(values.get(6, b"")).decode().lstrip(".")
            fields[bytes(values[1]).decode()] = (int(values[3]), kind)
        for nested in _all(message, 3):
            add(name, nested)

    for one in descriptor_sets:
        for file in _all(one, 1):
            package = b"".join(_all(file, 2)[:1]).decode()
            for message in _all(file, 4):
                add(package, message)
    return found


def field_numbers(types: dict[str, dict[str, tuple[int, str]]], name: str) -> dict[str, int] | None:
    """Numbers of a message's fields, and of their own fields as `field.inner`; null for an unknown message."""
    if name not in types:
        return None
    out = {}
    for field, (number, kind) in types[name].items():
        out[field] = number
        out |= {f"{field}.{inner}": n for inner, (n, _) in types.get(kind, {}).items()}
    return out
