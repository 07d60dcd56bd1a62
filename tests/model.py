"""A sequential model of the change log: what the set-based operators must agree with."""

from __future__ import annotations


class KeyModel:
    """Row state by applying changes one after the other. Versions are tuples (hlc, source, ordinal)."""

    def __init__(self):
        self.deleted = self.newest = self.image = None
        self.registers: dict[str, tuple] = {}

    def latest(self):
        found = [v for v in (self.deleted, self.newest, *(r[0] for r in self.registers.values())) if v is not None]
        return max(found, default=None)

    def apply(self, version, op, image=None, columns=None) -> bool:
        """image: list of (name, value); columns: names or None for all. Whether the state moved."""
        if self.deleted is not None and version <= self.deleted:
            return False
        if op == "d":
            self.deleted = version
            self.registers = {c: r for c, r in self.registers.items() if r[0] > version}
            if self.newest is not None and self.newest <= version:
                self.newest = self.image = None
            return True
        moved = False
        if self.newest is None or version > self.newest:
            self.newest, self.image, moved = version, image, True
        for name, value in image:
            if (columns is None or name in columns) and (name not in self.registers or version > self.registers[name][0]):
                self.registers[name] = (version, value)
                moved = True
        return moved

    def row(self):
        if self.newest is None:
            return None
        own = dict(self.image)
        shown = [(n, self.registers[n][1] if n in self.registers else v) for n, v in self.image]
        return shown + [(n, self.registers[n][1]) for n in sorted(self.registers) if n not in own]


def stamps(clocks: list[int], floor: int = 0) -> list[int]:
    """Clock stamps of commits in order: the clock in the upper bits, or one more than the last stamp."""
    out, last = [], floor
    for millis in clocks:
        last = max(max(0, millis) << 16, last + 1)
        out.append(last)
    return out


def contiguous_mark(finished: dict[int, bool], start: int = 0) -> int:
    mark = start
    for seq in sorted(finished):
        if not finished[seq]:
            break
        mark = seq
    return mark
