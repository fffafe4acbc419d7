"""Source maps of compiled classes (JSR 45): output lines back to input lines and files."""

from __future__ import annotations

import re
from typing import NamedTuple

_LINE = re.compile(r"^(\d+)(?:#(\d+))?(?:,(\d+))?:(\d+)(?:,(\d+))?$")


class Mapping(NamedTuple):
    input_start: int
    file: int
    repeat: int
    output_start: int
    step: int

    def resolve(self, output: int) -> int | None:
        step = max(self.step, 1)
        at = output - self.output_start
        return self.input_start + at // step if 0 <= at < max(self.repeat, 1) * step else None


class SourceMap(NamedTuple):
    stratum: str
    mappings: list[Mapping]
    files: dict[int, str]

    def resolve(self, output: int, own: str | None = None) -> tuple[int | None, str | None]:
        """(line, None) in the class's own file, (None, name) if the line is another file's; without a mapping the line itself."""
        for m in self.mappings:
            line = m.resolve(output)
            if line is not None:
                name = self.files.get(m.file)
                return (line, None) if own is None or name is None or name == own else (None, name)
        return output, None


def parse(text: str | None) -> SourceMap | None:
    """The call-site stratum if there is one, else the default, else the first with lines; None without any. Bad lines are skipped."""
    rows = (text or "").splitlines()
    if len(rows) < 3 or rows[0].strip() != "SMAP":
        return None
    default = current = rows[2].strip()
    strata: dict[str, tuple[list[Mapping], dict[int, str]]] = {}
    section, last_file, skip = "", 0, False
    for row in rows[3:]:
        row = row.rstrip()
        if skip:
            skip = False
        elif row == "*E":
            break
        elif row.startswith("*S "):
            current, section = row[3:].strip(), ""
        elif row.startswith("*"):
            section = row[1:2]
        elif section == "F":
            skip = row.startswith("+ ")
            number, _, name = row.removeprefix("+ ").strip().partition(" ")
            if number.isdigit() and name:
                strata.setdefault(current, ([], {}))[1][int(number)] = name.strip()
        elif section == "L" and (m := _LINE.match(row.strip())):
            start, file, repeat, out, step = m.groups()
            last_file = int(file) if file else last_file
            strata.setdefault(current, ([], {}))[0].append(Mapping(int(start), last_file, int(repeat or 1), int(out), int(step or 1)))
    for name in ("KotlinDebug", default, *strata):
        if strata.get(name, ([],))[0]:
            return SourceMap(name, *strata[name])
    return None
