"""Settings in files: sections of keys and values, as in ini files. Lines that begin with # or ; are comments."""

from __future__ import annotations

import configparser

from millrace.errors import EngineError


class Config:
    """The sections of a file, or of text. Names of keys keep their case; a section that is missing is empty."""

    def __init__(self, text: str) -> None:
        self._parser = configparser.ConfigParser(interpolation=None, strict=False)
        self._parser.optionxform = str
        try:
            self._parser.read_string(text)
        except configparser.Error as e:
            raise EngineError("configuration", str(e).splitlines()[0]) from e

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            with open(path, encoding="utf-8") as f:
                return cls(f.read())
        except OSError as e:
            raise EngineError("configuration", str(e)) from e

    @property
    def sections(self) -> list[str]:
        return self._parser.sections()

    def section(self, name: str) -> dict[str, str]:
        return dict(self._parser[name]) if self._parser.has_section(name) else {}

    def get(self, section: str, key: str, default: str | None = None) -> str:
        """A value; EngineError where neither the file nor a default has one."""
        value = self.section(section).get(key, default)
        if value is None:
            raise EngineError("configuration", f"no {key} in [{section}]")
        return value
