"""Crawl options with their defaults, as a plan's parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Auth:
    kind: str = "none"  # none, basic, bearer, cookie, form
    username: str | None = None
    password: str | None = None
    token: str | None = None
    cookies: tuple[tuple[str, str], ...] = ()
    login_url: str | None = None


@dataclass(frozen=True)
class CrawlConfig:
    base_url: str = ""
    max_depth: int = 3
    max_pages: int = 100
    max_assets: int = 1000
    concurrency: int = 5
    capture_assets: bool = True
    asset_types: tuple[str, ...] = ("css", "js", "image", "font")
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    respect_robots: bool = True
    same_domain_only: bool = True
    follow_redirects: bool = True
    retry_count: int = 3
    generate_manifest: bool = True
    user_agent: str = "*"
    auth: Auth = field(default_factory=Auth)

    @classmethod
    def of(cls, options: dict) -> CrawlConfig:
        """Defaults under the given options; None counts as not given, unknown names are refused."""
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**{k: v for k, v in options.items() if v is not None})

    def with_max_depth(self, n: int) -> CrawlConfig:
        return replace(self, max_depth=n)

    def with_max_pages(self, n: int) -> CrawlConfig:
        return replace(self, max_pages=n)

    def with_asset_types(self, *types: str) -> CrawlConfig:
        return replace(self, asset_types=types)

    def with_include(self, *globs: str) -> CrawlConfig:
        return replace(self, include=globs)

    def with_exclude(self, *globs: str) -> CrawlConfig:
        return replace(self, exclude=globs)


def cookies(text: str) -> tuple[tuple[str, str], ...]:
    """``a=1; b=x=y`` split at the first =; empty names are dropped."""
    pairs = (p.strip().partition("=") for p in text.split(";"))
    return tuple((name.strip(), value.strip()) for name, _, value in pairs if name.strip())


def auth_of(options: dict) -> Auth:
    """The variant that ``kind`` names; an unknown one is none."""
    kind = options.get("kind", "none")
    if kind == "basic":
        return Auth("basic", options.get("username"), options.get("password"))
    if kind == "bearer":
        return Auth("bearer", token=options.get("token"))
    if kind == "cookie":
        return Auth("cookie", cookies=cookies(options.get("cookies") or ""))
    if kind == "form":
        return Auth("form", options.get("username"), options.get("password"), login_url=options.get("login_url"))
    return Auth()
