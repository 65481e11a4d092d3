"""Options with their defaults; a caller's values come before a file's, and a file's before these."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Configuration:
    hash_method: str = "phash"
    hash_threshold: int = 22
    angular_threshold: float = 0.8979591836734693
    sigmoid_threshold: float = 0.42857142857142855
    scene_threshold: float = 0.15
    scene_width: int = 320
    scene_height: int = 240
    quorum: float = 0.0
    same_document_weight: float = 5.0
    other_document_weight: float = 2.0
    history: int = 2
    frame_width: int = 720
    frame_height: int = 576


def load(path: str | None = None, **own) -> Configuration:
    """Defaults, replaced by the values of an INI file's sections, replaced by keyword arguments."""
    kinds, found = {f.name: type(f.default) for f in fields(Configuration)}, {}
    if path:
        parser = configparser.ConfigParser()
        with open(path, encoding="utf-8") as file:
            parser.read_file(file)
        found = {k: kinds[k](v) for section in parser.sections() for k, v in parser[section].items() if k in kinds}
    return replace(Configuration(), **{**found, **own})
