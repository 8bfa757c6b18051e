"""Client of a spell-check service over HTTP, and the languages it knows.

The client is made once per task (``similarity.dictionary_similarity``); any other function from a text to
its number of findings can take its place.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

# Key of three letters, key of two letters, the service's name of the language.
LANGUAGES = (
    ("ger", "de", "de-de"), ("ara", "ar", "ar"), ("dut", "nl", "nl"), ("eng", "en", "en-gb"), ("fre", "fr", "fr"), ("gre", "el", "el"),
    ("grc", "el", "el"), ("ita", "it", "it"), ("pol", "pl", "pl-pl"), ("spa", "es", "es"), ("swe", "sv", "sv"),
)
# What is asked of the service beside text and language.
REQUEST = {"enableHiddenRules": "true", "level": "picky", "disabledRules": "WHITESPACE_RULE", "mode": "allButTextLevelOnly", "allowIncompleteResults": "false"}


def language(key: str) -> str:
    """The service's name of a language given by its key of three letters; a ValueError for an unknown one."""
    for three, _, name in LANGUAGES:
        if key == three:
            return name
    raise ValueError(f"unknown language {key!r}; known are {', '.join(x[0] for x in LANGUAGES)}")


def service(url: str, key: str, timeout: float = 30.0) -> Callable[[], Callable[[str], int]]:
    """Makes clients of the service at ``url`` for the language ``key``; an answer other than 2xx raises."""
    name = language(key)

    def make() -> Callable[[str], int]:
        def check(text: str) -> int:
            form = urllib.parse.urlencode({"text": text, "language": name, **REQUEST}).encode()
            with urllib.request.urlopen(f"{url.rstrip('/')}/v2/check", form, timeout=timeout) as answer:  # noqa: S310
                return len(json.load(answer)["matches"])

        return check

    return make
