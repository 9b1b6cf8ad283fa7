"""Which files a framework uses without an import, as Column predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE = r"\.(tsx?|jsx?)$"
_VITE = r"^src/main\.(tsx|jsx|ts|js)$|^index\.html$|^vite\.config\.(ts|js|mjs)$"
#: Special files of an app folder, and those that stand at the root or in ``src`` instead (fixed values).
_APP = "page|layout|loading|error|not-found|template|default|route|global-error|opengraph-image|twitter-image|sitemap|robots|icon|apple-icon"
_ROOT = "middleware|proxy|instrumentation"
#: What each framework uses by itself (fixed values).
_RULES: dict[str, str] = {
    "nextjs-app": rf"^(src/)?({_ROOT}){_CODE}|^(src/)?app/(.*/)?({_APP}){_CODE}",
    "nextjs-pages": rf"^(src/)?(middleware|proxy){_CODE}|^(src/)?pages/(?!(.*/)?(middleware|proxy){_CODE}).*{_CODE}",
    "vite-react": _VITE,
    "vite-react-router": rf"{_VITE}|^src/(routes|pages)/.*{_CODE}|^src/root\.(tsx|jsx)$|^src/(router|routes)\.(tsx|ts)$",
    "vite-tanstack-router": rf"{_VITE}|^src/routes/.*{_CODE}|routeTree\.gen\.(ts|tsx|js|jsx)$|route-manifest\.json$|^src/router\.(tsx|ts)$",
    "node-backend": r"^(src/)?(index|main|server|app)\.(ts|js|mjs|cjs)$|^(package|tsconfig)\.json$|\.config\.(ts|js|mjs)$|(^|/)(routes|controllers|middlewares?|handlers)(/|$)|/(migrations|seeds)/",
    "vue-nuxt": r"^src/main\.(ts|js)$|^src/App\.vue$|^(app|App)\.vue$|^nuxt\.config\.(ts|js)$|^vite\.config\.(ts|js)$|^vue\.config\.(js|ts)$|^(src/)?(components|composables|utils|server|middleware|plugins|layouts|pages)/|^app\.config\.(ts|js)$|^(public/)?index\.html$|\.vue$",
    "angular": r"^src/(main|polyfills)\.(ts|js)$|^\.?angular\.json$|^angular-cli\.json$|^src/index\.html$|^src/app/app\.(module|component|config|routes)\.ts$|/environments/|\.(component|module|service|guard|pipe|directive|interceptor|resolver)\.(ts|js)$|-routing\.module\.(ts|js)$|^src/assets/|^src/styles\.(css|scss|sass|less)$",
}
#: Globs that each framework leaves out of a scan (fixed values).
IGNORED: dict[str, tuple[str, ...]] = {
    "nextjs-app": (".next/**", "out/**", "next-env.d.ts"),
    "nextjs-pages": (".next/**", "out/**", "next-env.d.ts"),
    "vite-react": ("dist/**", ".vite/**", "vite.config.ts.timestamp-*"),
    "vite-react-router": ("dist/**", ".vite/**", "vite.config.ts.timestamp-*"),
    "vite-tanstack-router": ("dist/**", ".vite/**", "vite.config.ts.timestamp-*", "**/routeTree.gen.ts", "**/routeTree.gen.tsx"),
    "node-backend": ("dist/**", "build/**", "node_modules/**", "coverage/**", ".nyc_output/**"),
    "vue-nuxt": ("dist/**", ".nuxt/**", ".output/**", "node_modules/**", ".vite/**"),
    "angular": ("dist/**", ".angular/**", "node_modules/**", "**/*.spec.ts", "**/*.spec.js", "e2e/**", "coverage/**"),
}
_registered: dict[str, Callable[[Column], Column]] = {}


def without_route_groups(path: Column) -> Column:
    """The path without ``(group)`` folders."""
    return F.array_join(F.filter(F.split(path, "/"), lambda part: ~part.rlike(r"^\(.*\)$")), "/")


def register(name: str, predicate: Callable[[Column], Column]) -> None:
    """Add a framework, or replace one."""
    _registered[name] = predicate


def ignored(patterns: list[str], framework: str | None) -> list[str]:
    """The ignore patterns of a rule set and, after them, those of its framework."""
    return [*patterns, *IGNORED.get(framework or "", ())]


def frameworks() -> list[str]:
    return sorted({*_RULES, *_registered})


def implicitly_used(path: Column, framework: str | None) -> Column:
    """Whether the framework uses the file by itself; unknown frameworks use none."""
    if framework in _registered:
        return _registered[framework](path)
    if framework not in _RULES:
        return F.lit(False)
    plain = F.regexp_replace(path, r"\\", "/")
    return (without_route_groups(plain) if framework == "nextjs-app" else plain).rlike(_RULES[framework])
