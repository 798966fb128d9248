"""Rule catalogues of pattern search, pattern detection and project analysis.

The patterns are kept in the common part of the Java, RE2 and Python dialects. MULTILINE rules are written with
``(?m)``; ``java`` adds unix line mode, so that only line feeds end lines.
"""

from __future__ import annotations

#: Name, language, pattern, description.
SEARCH_RULES = (
    ("py_class", "python", r"(?m)^class\s+(\w+)(?:\(([^)]*)\))?:", "Python class definition"),
    ("py_function", "python", r"(?m)^(?:async\s+)?def\s+(\w+)\s*\(", "Python function/method definition"),
    ("py_import", "python", r"(?m)^(?:from\s+([\w.]+)\s+)?import\s+(.+)$", "Python import statement"),
    ("py_decorator", "python", r"(?m)^@(\w+(?:\.\w+)*(?:\([^)]*\))?)", "Python decorator"),
    ("py_dataclass", "python", r"(?m)@dataclass[^\n]*\nclass\s+(\w+)", "Python dataclass"),
    ("js_function", "javascript", r"(?:async\s+)?function\s+(\w+)\s*\(|const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", "JavaScript function definition"),
    ("js_class", "javascript", r"class\s+(\w+)(?:\s+extends\s+(\w+))?", "JavaScript class definition"),
    ("js_import", "javascript", r"import\s+(?:\{[^}]+\}|\w+|\*\s+as\s+\w+)\s+from\s+['\"]([^'\"]+)['\"]", "JavaScript import statement"),
    ("js_export", "javascript", r"export\s+(?:default\s+)?(?:class|function|const|let|var)\s+(\w+)", "JavaScript export"),
    ("ts_interface", "typescript", r"interface\s+(\w+)(?:\s+extends\s+([^{]+))?", "TypeScript interface definition"),
    ("ts_type", "typescript", r"type\s+(\w+)\s*=", "TypeScript type alias"),
    ("ts_enum", "typescript", r"enum\s+(\w+)\s*\{", "TypeScript enum definition"),
    ("go_function", "go", r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", "Go function definition"),
    ("go_struct", "go", r"type\s+(\w+)\s+struct\s*\{", "Go struct definition"),
    ("go_interface", "go", r"type\s+(\w+)\s+interface\s*\{", "Go interface definition"),
    ("go_method", "go", r"func\s+\((\w+)\s+\*?(\w+)\)\s+(\w+)\s*\(", "Go method definition"),
    ("todo", None, r"(?im)(?:#|//|/\*)\s*TODO[:\s](.+?)(?:\*/)?$", "TODO comments"),
    ("fixme", None, r"(?im)(?:#|//|/\*)\s*FIXME[:\s](.+?)(?:\*/)?$", "FIXME comments"),
    ("hack", None, r"(?im)(?:#|//|/\*)\s*HACK[:\s](.+?)(?:\*/)?$", "HACK comments"),
    ("url", None, r"https?://[^\s\"'<>]+", "URLs in code/comments"),
)

#: Pattern type, pattern, confidence; in the order in which a type's rules are tried.
DETECTION_RULES = (
    ("singleton", r"_instance\s*=\s*None|__instance\s*=\s*None", 0.8),
    ("singleton", r"def\s+get_instance|def\s+instance\s*\(", 0.7),
    ("singleton", r"@staticmethod\s+def\s+get_instance", 0.9),
    ("factory", r"class\s+\w*Factory\w*\s*[:(]", 0.9),
    ("factory", r"def\s+create_\w+\s*\(|def\s+make_\w+\s*\(", 0.7),
    ("factory", r"def\s+build_\w+\s*\(", 0.6),
    ("builder", r"class\s+\w*Builder\w*\s*[:(]", 0.9),
    ("builder", r"def\s+with_\w+\s*\(|def\s+set_\w+\s*\(", 0.7),
    ("builder", r"def\s+build\s*\(\s*self\s*\)", 0.8),
    ("observer", r"def\s+subscribe\s*\(|def\s+add_observer\s*\(", 0.8),
    ("observer", r"def\s+notify\s*\(|def\s+emit\s*\(", 0.7),
    ("observer", r"_observers\s*=|_listeners\s*=|_subscribers\s*=", 0.8),
    ("strategy", r"class\s+\w*Strategy\w*\s*[:(]", 0.9),
    ("strategy", r"def\s+set_strategy\s*\(|def\s+execute\s*\(", 0.7),
    ("dependency_injection", r"def\s+__init__\s*\(\s*self\s*,\s*\w+\s*:\s*\w+", 0.6),
    ("dependency_injection", r"@inject|@Inject", 0.9),
    ("dependency_injection", r"container\.resolve|injector\.get", 0.8),
    ("repository", r"class\s+\w*Repository\w*\s*[:(]", 0.9),
    ("repository", r"def\s+find_by_\w+\s*\(|def\s+get_all\s*\(", 0.7),
    ("repository", r"def\s+save\s*\(|def\s+delete\s*\(|def\s+update\s*\(", 0.6),
    ("service", r"class\s+\w*Service\w*\s*[:(]", 0.9),
    ("service", r"class\s+\w*Manager\w*\s*[:(]", 0.7),
    ("camelCase_function_naming", r"def\s+[a-z]+[A-Z][a-zA-Z]*\s*\(", 0.8),
    ("PascalCase_class_naming", r"class\s+[A-Z][a-zA-Z]*\s*[:(]", 0.9),
    ("snake_case_naming", r"[a-z]+_[a-z]+\s*=", 0.7),
    ("snake_case_naming", r"def\s+[a-z]+_[a-z]+\s*\(", 0.8),
    ("SCREAMING_SNAKE_CASE_constant", r"(?m)^[A-Z][A-Z_0-9]+\s*=", 0.9),
    ("testing", r"def\s+test_\w+\s*\(|class\s+Test\w+", 0.9),
    ("testing", r"@pytest\.|import\s+pytest|import\s+unittest", 0.9),
    ("testing", r"assert\s+\w+|self\.assert\w+", 0.7),
    ("api_design", r"@app\.route|@router\.|@api\.", 0.9),
    ("api_design", r"def\s+(?:get|post|put|delete|patch)_\w+", 0.7),
    ("error_handling", r"try:\s*\n|except\s+\w+:|raise\s+\w+", 0.7),
    ("error_handling", r"class\s+\w*Error\s*\(|class\s+\w*Exception\s*\(", 0.8),
    ("logging", r"logger\.\w+|logging\.\w+|log\.\w+", 0.8),
    ("logging", r"import\s+logging|from\s+logging\s+import", 0.9),
    ("configuration", r"class\s+\w*Config\w*\s*[:(]|class\s+\w*Settings\w*\s*[:(]", 0.9),
    ("configuration", r"\.env|environ\.get|os\.getenv", 0.7),
)

#: Language, framework, pattern.
FRAMEWORK_RULES = (
    ("python", "FastAPI", r"from\s+fastapi\s+import|import\s+fastapi"),
    ("python", "Flask", r"from\s+flask\s+import|import\s+flask"),
    ("python", "Django", r"from\s+django|import\s+django|DJANGO_SETTINGS"),
    ("python", "FastMCP", r"from\s+mcp|import\s+mcp|fastmcp"),
    ("python", "SQLAlchemy", r"from\s+sqlalchemy|import\s+sqlalchemy"),
    ("python", "Pydantic", r"from\s+pydantic|import\s+pydantic"),
    ("python", "pytest", r"import\s+pytest|from\s+pytest"),
    ("python", "asyncio", r"import\s+asyncio|async\s+def"),
    ("python", "Click", r"import\s+click|from\s+click|@click\."),
    ("python", "Typer", r"import\s+typer|from\s+typer"),
    ("typescript", "React", r"from\s+['\"]react['\"]|import\s+React"),
    ("typescript", "Next.js", r"from\s+['\"]next|next/"),
    ("typescript", "Express", r"from\s+['\"]express['\"]|require\(['\"]express"),
    ("typescript", "NestJS", r"from\s+['\"]@nestjs|@Module|@Controller"),
    ("typescript", "Vue", r"from\s+['\"]vue['\"]|createApp"),
    ("typescript", "Angular", r"@angular/core|@Component"),
    ("javascript", "React", r"from\s+['\"]react['\"]|require\(['\"]react"),
    ("javascript", "Express", r"require\(['\"]express['\"]|from\s+['\"]express"),
    ("javascript", "Vue", r"from\s+['\"]vue['\"]|createApp|Vue\."),
    ("go", "Gin", r"github\.com/gin-gonic/gin"),
    ("go", "Echo", r"github\.com/labstack/echo"),
    ("go", "Fiber", r"github\.com/gofiber/fiber"),
    ("go", "GORM", r"gorm\.io/gorm"),
    ("rust", "Actix", r"actix-web|actix_web"),
    ("rust", "Axum", r"use\s+axum::"),
    ("rust", "Tokio", r"use\s+tokio::"),
    ("rust", "Serde", r"use\s+serde::|serde_json"),
)

#: File names that are entry points; names with cli are of type cli, with app or server api, others main.
ENTRY_FILES = ("main.py", "__main__.py", "app.py", "server.py", "cli.py", "index.ts", "index.js", "main.go", "main.rs")
#: Entry type, description, pattern; the first that fits counts.
ENTRY_RULES = (
    ("main", "CLI", r"def\s+main\s*\(|if\s+__name__\s*==\s*['\"]__main__['\"]"),
    ("api", "HTTP API", r"app\s*=\s*(?:FastAPI|Flask|express)\s*\("),
    ("cli", "CLI", r"@click\.command|@app\.command|typer\.run"),
    ("test", "Test Suite", r"def\s+test_|class\s+Test"),
    ("setup", "Package Setup", r"setup\s*\(|pyproject\.toml"),
)
#: Directory type and the names that have it; the first that fits counts.
DIRECTORY_TYPES = (
    ("source", "src lib app core"),
    ("tests", "tests test __tests__ spec"),
    ("configuration", "config conf settings"),
    ("documentation", "docs doc documentation"),
    ("assets", "assets static public resources"),
    ("scripts", "scripts bin tools"),
    ("api", "api routes endpoints handlers"),
    ("models", "models entities domain"),
    ("services", "services providers use_cases"),
    ("utils", "utils helpers common shared"),
)
#: Pattern type and its keywords, with the reason given for it.
RECOMMENDATION_RULES = (
    ("service", ("service", "business logic", "handler"), "For business logic and coordination between components"),
    ("repository", ("repository", "data access", "database", "crud", "storage"), "For abstracting data persistence and retrieval"),
    ("factory", ("factory", "create", "instantiate", "construct"), "For creating objects without specifying exact classes"),
    ("builder", ("builder", "complex object", "step by step", "fluent"), "For constructing complex objects incrementally"),
    ("singleton", ("singleton", "single instance", "global", "shared"), "For ensuring only one instance exists"),
    ("observer", ("observer", "event", "subscribe", "notify", "listener", "callback"), "For event-driven communication between components"),
    ("strategy", ("strategy", "algorithm", "interchangeable", "policy"), "For making algorithms interchangeable at runtime"),
    ("dependency_injection", ("dependency injection", "di", "inject", "container", "ioc"), "For loose coupling and testability"),
    ("testing", ("test", "testing", "unittest", "pytest", "spec"), "For test-driven development practices"),
    ("api_design", ("api", "endpoint", "route", "rest", "http"), "For RESTful API design"),
    ("error_handling", ("error", "exception", "handle", "catch"), "For structured error handling"),
    ("logging", ("log", "logging", "debug", "trace"), "For consistent logging practices"),
    ("configuration", ("config", "configuration", "settings", "environment"), "For configuration management"),
)
#: Keyword and the patterns it suggests.
SUGGESTION_RULES = (
    ("create", ("Factory", "Builder")), ("service", ("Service", "Repository")), ("api", ("API Design", "Error Handling")), ("test", ("Testing",)),
    ("event", ("Observer",)), ("single", ("Singleton",)), ("inject", ("Dependency Injection",)),
)
#: Keyword and the directories it points to.
KEYWORD_DIRECTORIES = (
    ("api", ("api", "routes", "endpoints")), ("test", ("tests", "test")), ("model", ("models", "entities")), ("service", ("services", "providers")),
    ("config", ("config", "settings")), ("util", ("utils", "helpers")),
)


def java(pattern: str) -> str:
    """The pattern for Spark: line ends are line feeds only."""
    return pattern.replace("(?im)", "(?imd)").replace("(?m)", "(?md)") if pattern.startswith("(?") and "m)" in pattern[:5] else "(?d)" + pattern
