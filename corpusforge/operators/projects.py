"""Project types by marker files, and the ignore patterns that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, glob_to_regex

#: Marker files and the project type that each tells.
MARKERS = {
    "package.json": "javascript",
    "package-lock.json": "javascript",
    "yarn.lock": "javascript",
    "pnpm-lock.yaml": "javascript",
    "requirements.txt": "python",
    "Pipfile": "python",
    "pyproject.toml": "python",
    "setup.py": "python",
    "build.gradle": "android",
    "build.gradle.kts": "android",
    "settings.gradle": "android",
    "pom.xml": "java",
    "Podfile": "ios",
    "Package.swift": "ios",
    "go.mod": "go",
    "composer.json": "php",
    "Cargo.toml": "rust",
    "Gemfile": "ruby",
    "*.csproj": "dotnet",
    "*.sln": "dotnet",
}
#: Directories that are not searched for markers.
SKIPPED = ["node_modules", "dist", "build", "target", "vendor", "coverage", "htmlcov", "typings", "nltk_data", "secrets", "venv", "env", "__pycache__", "eggs", ".eggs"]
#: Ignore patterns of each project type.
PATTERNS = {
    "javascript": [
        "**/node_modules/**", "**/.next/**", "**/dist/**", "**/build/**", "**/.nuxt/**", "**/.output/**", "**/.vercel/**", "**/.netlify/**", "**/out/**", "**/coverage/**", "**/.nyc_output/**",
        "**/npm-debug.log*", "**/yarn-debug.log*", "**/yarn-error.log*", "**/.pnpm-store/**", "**/.turbo/**", "**/package-lock.json", "**/pnpm-lock.yaml", "**/bun.lockb", "**/yarn.lock",
    ],
    "python": [
        "**/__pycache__/**", "**/*.pyc", "**/*.pyd", "**/.Python", "**/build/**", "**/develop-eggs/**", "**/dist/**", "**/downloads/**", "**/eggs/**", "**/.eggs/**", "**/lib/**", "**/lib64/**",
        "**/parts/**", "**/sdist/**", "**/var/**", "**/*.egg-info/**", "**/.installed.cfg", "**/*.egg", "**/.venv/**", "**/venv/**", "**/env/**", "**/ENV/**", "**/.pytest_cache/**", "**/htmlcov/**",
        "**/.tox/**", "**/.coverage", "**/.hypothesis/**", "**/.mypy_cache/**", "**/.ruff_cache/**",
    ],
    "java": [
        "**/target/**", "**/.gradle/**", "**/build/**", "**/.idea/**", "**/*.iml", "**/out/**", "**/gen/**", "**/classes/**", "**/.classpath", "**/.project", "**/.settings/**", "**/.m2/**",
        "**/*.class", "**/*.jar", "**/*.war", "**/*.ear",
    ],
    "android": [
        "**/.gradle/**", "**/build/**", "**/.idea/**", "**/*.iml", "**/local.properties", "**/captures/**", "**/.externalNativeBuild/**", "**/.cxx/**", "**/*.apk", "**/*.aar", "**/*.ap_", "**/*.dex",
        "**/google-services.json", "**/gradle-app.setting", "**/.navigation/**",
    ],
    "ios": [
        "**/Pods/**", "**/DerivedData/**", "**/xcuserdata/**", "**/*.xcarchive", "**/build/**", "**/.build/**", "**/Packages/**", "**/.swiftpm/**", "**/Carthage/Build/**", "**/fastlane/report.xml",
        "**/fastlane/Preview.html", "**/fastlane/screenshots/**", "**/fastlane/test_output/**", "**/*.moved-aside", "**/*.xcuserstate", "**/*.hmap", "**/*.ipa",
    ],
    "go": ["**/vendor/**", "**/bin/**", "**/pkg/**", "**/*.exe", "**/*.test", "**/*.prof"],
    "php": ["**/vendor/**", "**/composer.phar", "**/composer.lock", "**/.phpunit.result.cache"],
    "rust": ["**/target/**", "**/Cargo.lock", "**/*.rs.bk"],
    "ruby": ["**/vendor/bundle/**", "**/.bundle/**", "**/Gemfile.lock", "**/.byebug_history"],
    "dotnet": ["**/bin/**", "**/obj/**", "**/packages/**", "**/*.user", "**/*.suo", "**/.vs/**", "**/node_modules/**"],
}
#: Ignore patterns that always hold.
COMMON_PATTERNS = [
    "**/.git/**", "**/.svn/**", "**/.hg/**", "**/.bzr/**", "**/.DS_Store", "**/Thumbs.db", "**/desktop.ini", "**/$RECYCLE.BIN/**",
    "**/*.bak", "**/*.backup", "**/*~", "**/*.swp", "**/*.swo", "**/*.swn", "**/#*#", "**/.#*", "**/*.lock", "**/.~lock*", "**/*.log", "**/logs/**", "**/*.log.*",
    "**/.vscode/**", "**/.idea/**", "**/.sublime-project", "**/.sublime-workspace", "**/nbproject/**", "**/.settings/**", "**/.metadata/**", "**/.classpath", "**/.project", "**/.c9/**",
    "**/*.launch", "**/*.tmproj", "**/*.tmproject", "**/tmtags", "**/.*.sw?", "**/Session.vim",
    "**/.env", "**/.env.local", "**/.env.*.local", "**/.env.production", "**/.env.development", "**/.env.test", "**/secrets.json", "**/secrets.yaml", "**/secrets.yml",
    "**/*.key", "**/*.pem", "**/*.crt", "**/*.cer", "**/*.p12", "**/*.pfx", "**/tmp/**", "**/temp/**", "**/*.tmp", "**/*.temp", "**/.cache/**",
    "**/.sass-cache/**", "**/connect.lock", "**/*.pid", "**/*.seed", "**/*.pid.lock", "**/coverage/**", "**/.nyc_output/**", "**/test-results/**", "**/*.cover", "**/*.coverage", "**/htmlcov/**",
    "**/docs/_build/**", "**/site/**", "**/*.orig", "**/core", "**/*.core",
]


def _type_of(name: Column, markers: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for marker, kind in reversed(markers.items()):
        out = F.when(name.rlike(glob_to_regex(marker)), kind).otherwise(out)
    return out


def detect_projects(files: DataFrame, max_depth: int = 2, markers: dict[str, str] = MARKERS, skip: list[str] = SKIPPED) -> DataFrame:
    """Distinct types of ``files(path)``, relative paths, from markers at most ``max_depth``
    folders deep, hidden and skipped folders left out."""
    folders = F.filter(F.split(dirname("path"), "/"), lambda d: (d != ".") & (d != ""))
    plain = ~F.exists(folders, lambda d: d.startswith(".") | d.isin(skip))
    return files.where((F.size(folders) <= max_depth) & plain).select(_type_of(basename("path"), markers).alias("type")).where("type is not null").distinct()


def smart_patterns(types: DataFrame, common: list[str] = COMMON_PATTERNS, patterns: dict[str, list[str]] = PATTERNS) -> DataFrame:
    """Distinct ignore patterns of the types, with those that always hold."""
    table = F.create_map(*[x for k, v in patterns.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    typed = types.select(F.explode(F.coalesce(F.try_element_at(table, F.col("type")), F.array().cast("array<string>"))).alias("pattern"))
    always = types.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in common])).alias("pattern"))
    return always.union(typed).distinct()
