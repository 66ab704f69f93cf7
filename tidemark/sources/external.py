"""Public pages behind injected transports: robots rules, polite fetching, responses stored with where they came from."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

Get = Callable[[str, dict[str, str], float], bytes]


@dataclass(frozen=True)
class Policy:
    """How a client behaves: its name, time limit, pause after each request, tries and whether robots rules bind it."""

    agent: str = "tidemark-research"
    timeout: float = 20.0
    pause: float = 1.0
    tries: int = 3
    backoff: float = 2.0
    check_robots: bool = True


def robots_url(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}/robots.txt"


def allowed(url: str, policy: Policy, get: Get) -> bool:
    """Whether the host's robots rules let this agent fetch the url.  Rules that can't be read allow nothing."""
    if not policy.check_robots:
        return True
    try:
        rules = get(robots_url(url), {"User-Agent": policy.agent}, policy.timeout).decode("utf-8", "replace")
    except OSError:
        return False
    parser = RobotFileParser()
    parser.parse(rules.splitlines())
    return parser.can_fetch(policy.agent, url)


def fetch(url: str, policy: Policy, get: Get, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """One permitted url.  Failures of the transport are tried again, each time after a longer wait; the last one is raised."""
    if not allowed(url, policy, get):
        raise PermissionError(f"robots rules do not permit {url}")
    for attempt in range(policy.tries):
        try:
            return get(url, {"User-Agent": policy.agent}, policy.timeout)
        except OSError:
            if attempt + 1 == policy.tries:
                raise
            sleep(policy.backoff**attempt)
        finally:
            sleep(policy.pause)
    raise ValueError("a policy needs a try at least")


def save_response(url: str, path: str | Path, policy: Policy, get: Get, sleep: Callable[[float], None] = time.sleep) -> Path:
    """The response's bytes, and beside them a JSON file with url, agent, time and size."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    payload = fetch(url, policy, get, sleep)
    target.write_bytes(payload)
    told = {"url": url, "user_agent": policy.agent, "fetched_at_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "bytes": len(payload)}
    target.with_suffix(target.suffix + ".json").write_text(json.dumps(told, ensure_ascii=False, indent=2), encoding="utf-8")
    return target
