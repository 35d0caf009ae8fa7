"""Tree paths: type:id, then edge or edge:id any number of times."""

from __future__ import annotations

from dataclasses import dataclass


class PathError(ValueError):
    """code: EmptyPath, InvalidFormat, InvalidNodeId, MissingRootId."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path!r}")
        self.code = code


@dataclass(frozen=True)
class TreePath:
    """segments: (name, id); only the last id may be None: an edge of its parent."""

    segments: tuple[tuple[str, int | None], ...]

    @classmethod
    def parse(cls, path: str) -> TreePath:
        if not path:
            raise PathError("EmptyPath", path)
        out: list[tuple[str, int | None]] = []
        parts = path.split("/")
        for k, part in enumerate(parts):
            name, colon, number = part.partition(":")
            if not name or (colon and ":" in number):
                raise PathError("InvalidFormat", path)
            if not colon:
                if k == 0:
                    raise PathError("MissingRootId", path)
                if k < len(parts) - 1:
                    raise PathError("InvalidFormat", path)
                out.append((name, None))
            elif number.isascii() and number.isdigit():
                out.append((name, int(number)))
            else:
                raise PathError("InvalidNodeId", path)
        return cls(tuple(out))

    @property
    def is_node(self) -> bool:
        return self.segments[-1][1] is not None

    def target(self) -> tuple[str, int] | tuple[str, int, str]:
        """("node", id), or ("edge", parent id, edge)."""
        name, number = self.segments[-1]
        return ("node", number) if number is not None else ("edge", self.segments[-2][1], name)

    @property
    def depth(self) -> int:
        return sum(1 for _, i in self.segments if i is not None) - 1

    def parent(self) -> TreePath | None:
        return TreePath(self.segments[:-1]) if len(self.segments) > 1 else None

    def __str__(self) -> str:
        return "/".join(n if i is None else f"{n}:{i}" for n, i in self.segments)
