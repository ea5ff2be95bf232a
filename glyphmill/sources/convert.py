"""python -m glyphmill.sources.convert MODEL [OUTPUT]: a BPE model file as a spec, to a file or to standard output.

Exit codes: 0; 2 if the model can't be converted, read or written. The output is replaced as a whole or not at all.
"""

from __future__ import annotations

import argparse
import os
import sys

from ..operators.stages import SpecError
from . import spec


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="convert", description=__doc__)
    parser.add_argument("model")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--unk-token", default="<unk>")
    parser.add_argument("--pretty", action="store_true")
    args = parser.parse_args(given)
    try:
        if args.output and os.path.realpath(args.output) == os.path.realpath(args.model):
            raise SpecError("the output would replace the model")
        made = spec.from_nlcodec(spec.read_text(args.model), args.unk_token)
        if args.output:
            spec.save(made, args.output, args.pretty)
        else:
            print(made.to_json(args.pretty))
    except (SpecError, OSError, UnicodeDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    aliases = sum(t.startswith(spec.ALIAS) for t in made.model["vocab"])
    print(f"{len(made.model['vocab'])} tokens" + (f", {aliases} of them spellings that come again" if aliases else ""), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
