"""Hosts of AI services whose traffic is watched."""

# Watched domains; a host is watched when it or a parent domain
# of at least two labels is listed.
DOMAINS = (
    "api.openai.com", "chat.openai.com", "chatgpt.com",
    "api.anthropic.com", "claude.ai",
    "generativelanguage.googleapis.com", "gemini.google.com",
    "api.copilot.microsoft.com", "copilot.microsoft.com", "copilot.cloud.microsoft",
    "api.perplexity.ai", "perplexity.ai", "www.perplexity.ai",
    "api.x.ai", "grok.com", "www.grok.com",
    "codestral.mistral.ai", "api.mistral.ai", "chat.mistral.ai", "le-chat.mistral.ai",
    "api.deepseek.com", "chat.deepseek.com",
    "api.duck.ai", "duck.ai", "www.duck.ai",
    "meta.ai", "www.meta.ai",
)
