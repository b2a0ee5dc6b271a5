"""Writing one condition for two SQL dialects: Spark's and the checking engine's.

Patterns are kept once, in the notation of Java and Python; `Duck` rewrites the
two things RE2 lacks (look-behind for a word character, \\xNN above 7F).
Values are shared text; how tables are built from them is written separately
for each engine.
"""

from __future__ import annotations

import re


class Spark:
    name = "spark"

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"

    @classmethod
    def pattern(cls, pattern: str, flags: str = "") -> str:
        """(?d): only \\n ends a line; (?U): Unicode classes, as in Python."""
        return cls.text(f"(?dU{flags}{'u' if 'i' in flags else ''})" + pattern)

    @classmethod
    def matches(cls, col: str, pattern: str, flags: str = "") -> str:
        return f"({col} rlike {cls.pattern(pattern, flags)})"

    @classmethod
    def extract(cls, col: str, pattern: str, group: int = 0, flags: str = "") -> str:
        return f"regexp_extract({col}, {cls.pattern(pattern, flags)}, {group})"

    @classmethod
    def extract_all(cls, col: str, pattern: str, group: int = 0, flags: str = "") -> str:
        return f"regexp_extract_all({col}, {cls.pattern(pattern, flags)}, {group})"

    @classmethod
    def replace(cls, col: str, pattern: str, to: str, flags: str = "") -> str:
        return f"regexp_replace({col}, {cls.pattern(pattern, flags)}, {cls.text(to.replace('{1}', '$1').replace('{2}', '$2'))})"

    @staticmethod
    def integer(col: str) -> str:
        return f"try_cast({col} as int)"


class Duck:
    name = "duck"

    @staticmethod
    def text(value: str) -> str:
        parts = re.split(r"([\n\r])", value)
        made = ["chr(10)" if p == "\n" else "chr(13)" if p == "\r" else "'" + p.replace("'", "''") + "'" for p in parts if p]
        return "(" + " || ".join(made) + ")" if len(made) > 1 else made[0] if made else "''"

    @staticmethod
    def _re2(pattern: str) -> str:
        pattern = pattern.replace(r"(?<!\w)", r"(?:^|\W)")
        return re.sub(r"\\x([89a-fA-F][0-9a-fA-F])", r"\\x{\1}", pattern)

    @classmethod
    def _options(cls, flags: str) -> str:
        return f", '{flags}'" if flags else ""

    @classmethod
    def matches(cls, col: str, pattern: str, flags: str = "") -> str:
        return f"regexp_matches({col}, {cls.text(cls._re2(pattern))}{cls._options(flags)})"

    @classmethod
    def extract(cls, col: str, pattern: str, group: int = 0, flags: str = "") -> str:
        return f"regexp_extract({col}, {cls.text(cls._re2(pattern))}, {group}{cls._options(flags)})"

    @classmethod
    def extract_all(cls, col: str, pattern: str, group: int = 0, flags: str = "") -> str:
        return f"regexp_extract_all({col}, {cls.text(cls._re2(pattern))}, {group}{cls._options(flags)})"

    @classmethod
    def replace(cls, col: str, pattern: str, to: str, flags: str = "") -> str:
        return f"regexp_replace({col}, {cls.text(cls._re2(pattern))}, {cls.text(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g{flags}')"

    @staticmethod
    def integer(col: str) -> str:
        return f"try_cast({col} as integer)"


def strip(d, col: str) -> str:
    """Python's str.strip() for the white space that occurs."""
    return d.replace(d.replace(col, r"^\s+", ""), r"\s+$", "")
