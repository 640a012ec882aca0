"""Script and markup injection pack."""

from textguard.rules.model import Rule, g

# Rule names, severities and patterns.
RULES = (
    Rule("xss_script_tag", "critical", r"(?i)<\s*script\b[^>]*>(?:[\s\S]*?<\s*/\s*script\s*>)?", "script element"),
    Rule("xss_event_handler", "high", r"""(?i)\s(?:on(?:click|error|load|mouseover|mouseout|focus|blur|submit|change|keydown|keyup|keypress|input|abort|resize|scroll|unload|drag|drop))\s*=\s*["'][^"']*["']""", "inline handler"),
    Rule("xss_javascript_url", "critical", r"""(?i)(?:href|src|action|formaction)\s*=\s*["']?\s*javascript:""", "script link"),
    Rule("xss_data_url", "high", r"""(?i)(?:href|src|action|formaction)\s*=\s*["']?\s*data:text/html""", "inline HTML link"),
    Rule("xss_svg_script", "critical", r"(?i)<\s*svg\b[^>]*(?:on\w+\s*=|<\s*script)", "SVG with script"),
    Rule("xss_dom_clobbering", "medium", r"""(?i)<\s*(?:a|form|img|iframe|input|embed|object)\b[^>]*\s(?:id|name)\s*=\s*["'](?:getElementById|cookie|write|forms|length|parent|top|name)\b""", "element shadowing a DOM name"),
    Rule("xss_svg_namespace_abuse", "critical", r"""(?i)<\s*svg\b[^>]*\s+(?:xmlns|xmlns:[a-z]+)\s*=\s*["'][^"']*["'][^>]*<\s*(?:foreignObject|animation|set|animate|use|script)\b""", "SVG namespace trick"),
    Rule("xss_mutation_xss", "high", r"(?i)<\s*(?:noembed|noscript|title|xmp|iframe|noframes|plaintext|listing)\b[^>]*>(?:[^<]|<[^/]){0,500}?(?:on\w+\s*=|javascript:)[^<]{0,500}?<\s*/\s*(?:noembed|noscript|title|xmp|iframe|noframes|plaintext|listing)\s*>", "mutating markup"),
    Rule("xss_polyglot", "high", r"""(?:alert|eval|prompt|confirm|document\.write)\s*\(\s*[`'"][^`'"]{0,200}?\$\{[^}]{0,100}?\}[^`'"]*[`'"]\s*\)""", "template call"),
    Rule("xss_svg_use_external", "critical", r"""(?i)<\s*use\b[^>]*\s(?:xlink:)?href\s*=\s*["']\s*(?:https?:|data:|file:|//)""", "external SVG use"),
    Rule("xss_javascript_data_url", "critical", r"""(?i)(?:href|src|action|formaction|xlink:href|background|poster|cite|usemap|data)\s*=\s*["']?\s*javascript:""", "script scheme in any link"),
    Rule("xss_meta_refresh", "medium", r"""(?i)<\s*meta\b[^>]*\shttp-equiv\s*=\s*["']\s*refresh\s*["'][^>]*\scontent\s*=\s*["'][^"']*javascript:""", "refresh into script"),
)

GATES = {
    "xss_script_tag": g("<", "script"),
    "xss_event_handler": g("=", ("click", "error", "load", "mouse", "focus", "blur", "submit", "change", "key", "input", "abort", "resize", "scroll", "drag", "drop"), "on"),
    "xss_javascript_url": g("javascript:"),
    "xss_data_url": g("data:text/html"),
    "xss_svg_script": g("svg"),
    "xss_dom_clobbering": g("<", ("getelementbyid", "cookie", "write", "forms", "length", "parent", "top", "name"), ("id", "name")),
    "xss_svg_namespace_abuse": g("svg", "xmlns"),
    "xss_mutation_xss": g("<", ("on", "javascript:"), ("noembed", "noscript", "title", "xmp", "iframe", "noframes", "plaintext", "listing")),
    "xss_polyglot": g("${"),
    "xss_svg_use_external": g("<", "use", "href"),
    "xss_javascript_data_url": g("javascript:"),
    "xss_meta_refresh": g("refresh", "javascript:"),
}
