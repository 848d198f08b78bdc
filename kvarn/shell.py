"""A command line over a store: ``python -m kvarn.shell <folder>``."""

from __future__ import annotations

import shlex
import sys

from kvarn.session import local_session
from kvarn.sources.store import KVStore

HELP = """PUT key value | GET key | DELETE key | STATS | HELP | EXIT
PREFIX_SCAN prefix page size | RANGE_SCAN start end page size
PREFIX_ITERATE prefix | RANGE_ITERATE start end   (then next, has_next, reset, stop)"""


class Shell:
    """One command a line; quotes hold blanks together. ``run`` returns what to print, or None at the end."""

    def __init__(self, store: KVStore):
        self.store, self.cursor = store, None

    def run(self, line: str) -> str | None:
        try:
            words = shlex.split(line)
        except ValueError as e:
            return f"error: {e}"
        if not words:
            return ""
        verb, args = words[0].upper(), words[1:]
        if self.cursor is not None and verb in ("NEXT", "HAS_NEXT", "RESET", "STOP"):
            return self._iterate(verb)
        names = {"DEL": "DELETE", "H": "HELP", "QUIT": "EXIT", "Q": "EXIT", "CLS": "CLEAR"}
        verb = names.get(verb, verb)
        arity = {"PUT": 2, "GET": 1, "DELETE": 1, "STATS": 0, "HELP": 0, "CLEAR": 0, "EXIT": 0, "PREFIX_SCAN": 3, "RANGE_SCAN": 4, "PREFIX_ITERATE": 1, "RANGE_ITERATE": 2}
        if verb not in arity:
            return f"unknown command {words[0]}"
        if len(args) != arity[verb]:
            return f"usage: {next(part.strip() for row in HELP.splitlines() for part in (row + ' | CLEAR').split('|') if part.strip().split()[0] == verb)}"
        try:
            return self._do(verb, args)
        except ValueError as e:
            return f"error: {e}"

    def _do(self, verb: str, args: list[str]) -> str | None:
        s = self.store
        if verb == "EXIT":
            s.commit()
            return None
        if verb in ("PUT", "DELETE"):
            s.put(*args) if verb == "PUT" else s.delete(*args)
            s.commit()
            return "ok"
        if verb == "GET":
            found = s.get(args[0])
            return "not found" if found is None else found
        if verb in ("PREFIX_SCAN", "RANGE_SCAN"):
            page, size = int(args[-2]), int(args[-1])
            rows = s.prefix_scan(args[0], page, size) if verb == "PREFIX_SCAN" else s.range_scan(args[0], args[1], page, size)
            return "\n".join(f"{k}\t{v}" for k, v in rows.collect())  # a page
        if verb in ("PREFIX_ITERATE", "RANGE_ITERATE"):
            self.cursor = s.prefix_iterate(*args) if verb == "PREFIX_ITERATE" else s.range_iterate(*args)
            return "iterator open"
        return {"STATS": str(s.stats()), "HELP": HELP, "CLEAR": "\x1b[2J\x1b[H"}[verb]

    def _iterate(self, verb: str) -> str:
        if verb == "HAS_NEXT":
            return str(self.cursor.has_next()).lower()
        if verb == "RESET":
            self.cursor.reset()
            return "reset"
        if verb == "STOP":
            self.cursor.stop()
            self.cursor = None
            return "stopped"
        found = self.cursor.next()
        return "end" if found is None else f"{found[0]}\t{found[1]}"


def main() -> None:
    shell = Shell(KVStore(local_session(), sys.argv[1] if len(sys.argv) > 1 else "kvarn-data"))
    print(HELP)
    try:
        while (out := shell.run(input("> "))) is not None:
            print(out)
    except EOFError:
        shell.store.commit()


if __name__ == "__main__":
    main()
