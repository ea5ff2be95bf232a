"""Reading and writing pipeline specs and their configuration, by Spark, so that any file system it knows will do."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..operators.stages import SpecError
from ..operators.tokenizer import Spec, Tokenizer


@dataclass(frozen=True)
class Config:
    bos: str | None = None
    eos: str | None = None
    pad: str | None = None
    unk: str | None = None
    add_bos: bool = False
    add_eos: bool = False
    templates: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        j = json.loads(text)
        token = lambda x: x.get("content") if isinstance(x, dict) else x
        template = j.get("chat_template")
        named = {"default": template} if isinstance(template, str) else {t["name"]: t["template"] for t in template or []}
        return cls(token(j.get("bos_token")), token(j.get("eos_token")), token(j.get("pad_token")), token(j.get("unk_token")), bool(j.get("add_bos_token", False)), bool(j.get("add_eos_token", False)), named)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load(spark: SparkSession, path: str) -> Spec:
    """A tokenizer.json, or the folder that holds it."""
    return Spec.parse(_text(spark, path if path.endswith(".json") else f"{path.rstrip('/')}/tokenizer.json"))


def load_config(spark: SparkSession, path: str) -> Config:
    return Config.parse(_text(spark, path if path.endswith(".json") else f"{path.rstrip('/')}/tokenizer_config.json"))


def save(spec: Spec, path: str, pretty: bool = True) -> None:
    """Writes a file on any file system that can be named by a URI; readers see the old file or the new one."""
    write_text(path, spec.to_json(pretty))


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def write_text(path: str, text: str) -> None:
    """A file as a whole: written beside its place, then moved there."""
    system, place = _located(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    aside = f"{os.path.dirname(place)}/.{os.path.basename(place)}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(aside) as out:
            out.write(text.encode())
        system.move(aside, place)
    except BaseException:
        if system.get_file_info(aside).type != fs.FileType.NotFound:
            system.delete_file(aside)
        raise


def read_text(path: str) -> str:
    """A whole file, where there is no session to read it (in a data source's tasks)."""
    system, place = _located(path)
    with system.open_input_stream(place) as source:
        return source.read().decode()


def vocabulary(spark: SparkSession, spec: Spec) -> DataFrame:
    """token, id of the model and of added tokens."""
    t = Tokenizer(spec)
    return spark.createDataFrame(sorted((t.model.ids | t.added).items(), key=lambda x: (x[1], x[0])), "token string, id int")


def merges(spark: SparkSession, spec: Spec) -> DataFrame:
    """left_id, right_id, rank, new_id of a BPE model."""
    rows = [(a, b, rank, new) for (a, b), (rank, new) in getattr(Tokenizer(spec).model, "merges", {}).items()]
    return spark.createDataFrame(rows, "left_id int, right_id int, rank int, new_id int")


# fixed values: what converted specs have in common with those of the format's other readers
SPACE, ALIAS = "▁", "\U000F0000nlcodec_duplicate_"
NLCODEC_BLANKS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _nlcodec_names(text: str) -> list[str]:
    """The tokens of a BPE model file by their index: a JSON header after '#', then tab-separated index, name, level, frequency, parts."""
    head, *lines = text.split("\n")
    try:
        about = json.loads(head[1:]) if head.startswith("#{") else None
    except ValueError as e:
        raise SpecError(f"header: {e}") from e
    if about is None:
        raise SpecError("header missing")
    names: list[str] = []
    for number, line in enumerate(lines[: -1 if lines and not lines[-1] else None], 2):
        cells = line.rstrip("\r").split("\t")
        try:
            index, *_ = numbers = [int(cells[k]) for k in (0, 2, 3)]
            parts = [int(c) for c in cells[4].split()] if len(cells) > 4 else []
        except (ValueError, IndexError) as e:
            raise SpecError(f"line {number}: four columns, of which three are numbers, are expected") from e
        if index != len(names) or len(numbers) != 3:
            raise SpecError(f"line {number}: indexes must follow each other")
        if not all(0 <= c < index for c in parts):
            raise SpecError(f"line {number}: parts must come before the whole")
        names.append(cells[1])
    scheme = about.get("scheme", "bpe" if about.get("max_level") == 1 else None)  # older files tell by their levels
    if scheme != "bpe":
        raise SpecError(f"only the scheme bpe can be converted, not {scheme}")
    if about.get("total", len(names)) != len(names) or not names:
        raise SpecError(f"the header tells of {about.get('total')} tokens, the file has {len(names)}")
    return names


def from_nlcodec(text: str, unknown: str = "<unk>") -> Spec:
    """A BPE model file as a spec: greedy longest pieces of texts whose white space is one mark, with the file's ids.

    A spelling that comes again gets an alias, which encoding never finds and decoding writes as the spelling.
    """
    vocab: dict[str, int] = {}
    aliases: list[tuple[str, str]] = []
    names = _nlcodec_names(text)
    for i, name in enumerate(names):
        if name in vocab:
            aliases.append((f"{ALIAS}{i}", name))
            name = aliases[-1][0]
        if name in vocab or name.startswith(ALIAS) and (not aliases or name != aliases[-1][0]):
            raise SpecError(f"{name!r} is a spelling of the file and an alias")
        vocab[name] = i
    for needed in (unknown, SPACE):
        if needed not in vocab:
            raise SpecError(f"{needed!r} is no token of the file")
    return Spec.of({
        "model": {"type": "WordPiece", "vocab": vocab, "unk_token": unknown, "continuing_subword_prefix": "", "max_input_chars_per_word": 2**31 - 1, "fuse_unk": False},
        "normalizer": {"type": "Sequence", "normalizers": [
            {"type": "Strip", "strip_left": True, "strip_right": True},
            {"type": "Replace", "pattern": {"Regex": NLCODEC_BLANKS}, "content": SPACE},
            {"type": "Replace", "pattern": {"Regex": "$"}, "content": SPACE}]},
        "pre_tokenizer": {"type": "Split", "pattern": {"String": SPACE}, "behavior": "MergedWithPrevious", "invert": False},
        "decoder": {"type": "Sequence", "decoders": [*({"type": "Replace", "pattern": {"String": a}, "content": name} for a, name in aliases), {"type": "BPE", "suffix": SPACE}]},
    })
