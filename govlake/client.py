"""Command line client: ``python -m govlake.client [-X get|post] URL PASSWORD [SQL]`` (SQL from stdin if absent); exit 1 on failure."""

from __future__ import annotations

import argparse
import sys
import urllib.error
import urllib.parse
import urllib.request


def ask(url: str, password: str, sql: str, method: str = "post", timeout: float = 300) -> str:
    """The reply to a statement, sent as the body or as ``?q=``."""
    place = url.rstrip("/") + "/query"
    if method == "get":
        place, data = f"{place}?{urllib.parse.urlencode({'q': sql})}", None
    else:
        data = sql.encode()
    request = urllib.request.Request(place, data=data, headers={"X-Password": password}, method=method.upper())
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return reply.read().decode()


def post(url: str, password: str, sql: str, timeout: float = 300) -> str:
    return ask(url, password, sql, "post", timeout)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="govlake.client")
    parser.add_argument("url")
    parser.add_argument("password")
    parser.add_argument("sql", nargs="?")
    parser.add_argument("-X", "--method", choices=("get", "post"), default="post")
    given = parser.parse_args(args)
    try:
        print(ask(given.url, given.password, given.sql if given.sql is not None else sys.stdin.read(), given.method))
    except urllib.error.HTTPError as error:
        print(error.read().decode() or error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
