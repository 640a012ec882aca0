"""Compliance and misuse phrases."""

from textguard.rules.model import Rule, either, g

# Rule names, severities and patterns.
RULES = (
    Rule("owasp_llm01_prompt_injection", "critical", r"(?i)(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?|context)|(?:^|\s)(?:new|updated?)\s+instructions?\s*:|system\s*:\s*you\s+are\s+now", "prompt injection"),
    Rule("owasp_llm04_model_dos", "high", r"(?i)(?:flood|overwhelm|DDoS|denial.of.service)\s+(?:the\s+)?(?:system|server|model|API)|(?:repeat|output)\s+(?:this\s+)?(?:sentence|phrase|word)\s+\d{3,}\s+times?", "overload request"),
    Rule("owasp_llm08_excessive_agency", "high", r"(?i)(?:use|run|execute|call|invoke)\s+(?:the\s+)?(?:file|shell|terminal|command|exec|system)\s+(?:tool|command|function|API)|(?:without|no)\s+(?:human\s+)?(?:oversight|review|approval|confirmation)", "unsupervised tool use"),
    Rule("owasp_llm09_overreliance", "medium", r"(?i)(?:is\s+this\s+(?:safe|legal|compliant|ethical|appropriate))|(?:should\s+I\s+(?:trust|rely\s+on|sign|send|submit))|(?:validate|verify|check)\s+(?:this\s+)?(?:for\s+me|before\s+I)", "asks for a ruling"),
    Rule("owasp_llm10_model_theft", "high", r"(?i)(?:extract|reveal|expose|leak|give\s+me)\s+(?:the\s+)?(?:model|weights?|parameters?|architecture|training\s+data|embeddings?)", "model extraction"),
    Rule("mitre_atlas_ta0001_reconnaissance", "low", r"(?i)(?:find|discover|probe|scan|test|examine|investigate|audit)\s+(?:the\s+)?(?:weaknesses?|vulnerabilities?|guard\s*rails?|safety\s+filters?|limit(?:ation)?s?|edge\s+cases?|behavior)\s+(?:of|in)\s+(?:this|the)\s+(?:model|AI|system|LLM|chatbot|assistant)", "probing a model"),
    Rule("owasp_llm06_sensitive_info_disclosure_system_prompt", "medium", r"(?i)(?:what(?:'s|\s+is)\s+)?(?:your|the)\s+(?:system\s+prompt|initial\s+instructions?|original\s+instructions?|hidden\s+instructions?|secret\s+instructions?|secret\s+prompt|underlying\s+prompt)|(?:reveal|show|print|display|output|expose|leak|share|give\s+me)\s+(?:your|the)\s+(?:system\s+message|system\s+prompt|initial\s+instructions?|original\s+instructions?|secret\s+instructions?|secret\s+prompt|underlying\s+prompt|hidden\s+prompt)", "asks for the system prompt"),
    Rule("eu_ai_act_article_5_prohibited", "high", r"(?i)(?:build|create|design|develop|implement|deploy|launch)\s+(?:a\s+)?(?:system|solution|tool|application|app|model|AI)\s+(?:that\s+(?:would\s+)?)?(?:discriminat(?:e|ion|ing|es?)\s+(?:based\s+on|based\s+upon|on\s+the\s+basis\s+of|by)\s+(?:race|gender|religion|ethnicity|national\s+origin|sexual\s+orientation|disability|age|political\s+opinion))|(?:social\s+credit(?:\s+system)?)|(?:subliminal\s+manipulation|manipulat(?:e|ion)\s+users?\s+(?:without\s+(?:their\s+)?(?:awareness|knowledge|consent)))|(?:exploit\s+(?:vulnerabilities?\s+of|weaknesses\s+of)\s+(?:children|minors|elderly|disabled|people\s+with\s+disabilities))|(?:biometric\s+categorization\s+(?:of|to\s+(?:infer|determine|classify))\s+(?:race|political\s+opinions?|religious\s+beliefs?))|(?:real-?time\s+remote\s+biometric\s+identification)|(?:predictive?\s+policing\s+system)", "prohibited practice"),
    Rule("owasp_llm09_overreliance_misinformation_explicit", "medium", r"(?i)(?:make\s+up|fabricat(?:e|ion|ed|ing)|invent|fake|create\s+(?:a\s+)?(?:fake|fabricated))\s+(?:a\s+)?(?:study|statistic|stat(?:s|istics)|source|citation|reference|quote|testimonial|review|article|news|headline|survey|paper|report)|(?:cite\s+(?:a\s+)?(?:fake|non-existent|fabricated|made-up|invented))|(?:write\s+(?:a\s+)?(?:misleading|fake|fabricated|inaccurate))\s+(?:article|headline|review|news|story|report)", "asks for invented facts"),
    Rule("owasp_llm10_unbounded_consumption", "medium", r"(?i)(?:run|process|repeat|generate|output|call)\s+(?:this\s+)?(?:1[0-9]{3,}|[2-9][0-9]{3,})\s+times?|(?:run|process)\s+(?:this\s+)?(?:dataset|list|data|requests?)\s+(?:repeatedly|in\s+a\s+loop|exhaustively|infinitely|forever|continuously)|(?:use\s+the\s+most\s+expensive\s+model)|(?:maximize|exhaust)\s+(?:the\s+)?(?:API|token|cost|budget|context)", "unbounded work"),
    Rule("mitre_atlas_ta0002_resource_development", "high", r"(?i)(?:give\s+me|create|generate|build|write)\s+(?:a\s+)?(?:tool|script|program|payload|exploit|malware|phishing\s+email|attack\s+tool)\s+(?:(?:that\s+(?:will\s+)?|to\s+))?(?:attack|exploit|breach|hack|compromise|bypass|infiltrate|pwn|target|phish)", "attack tooling"),
    Rule("owasp_llm05_supply_chain", "medium", r"(?i)(?:install|load|import|use|deploy|register|fetch|download)\s+(?:this\s+|the\s+|a\s+)?(?:untrusted|unverified|unknown|custom|third-party|external|community)\s+(?:model|plugin|extension|package|library|module|tool|API|endpoint|repository|repo|checkpoint|weights?)", "untrusted component"),
    Rule("eu_ai_act_article_10_data_governance", "medium", r"(?i)(?:train|retrain|fine-?tune|fit)\s+(?:the\s+)?(?:model|network|system|LLM)\s+(?:on|with)\s+(?:this\s+|the\s+)?(?:personal\s+data|PII|sensitive\s+data|user\s+data|user-?generated\s+content|UGC|children'?s?\s+data|biased\s+data|unrepresentative\s+data|unbalanced\s+dataset|incomplete\s+data|outdated\s+data)", "training on problem data"),
    Rule("mitre_atlas_ta0009_collection", "high", r"(?i)(?:scrape|extract|harvest|collect|gather|compile)\s+(?:all\s+the\s+|the\s+|all\s+)?(?:training\s+data|training\s+(?:examples?|corpus|set)|labeled\s+data|annotated\s+data|dataset\s+(?:examples?|rows|records?|entries?))", "collecting training data"),
    Rule("owasp_llm02_insecure_output", "high", r"(?i)(?:output|return|render|generate|include|insert)\s+(?:HTML|markdown|JavaScript|JS|code|script|iframe|eval|innerHTML|outerHTML)\s+(?:that\s+(?:will\s+)?)?(?:execute|run|be\s+evaluated|be\s+interpreted|be\s+rendered|inject|executes?\s+in\s+the\s+(?:browser|page|DOM))|(?:the\s+response\s+(?:will\s+)?(?:be\s+)?(?:evaluated|executed|rendered)\s+(?:as|in\s+the))\s+(?:HTML|code|script|browser|DOM|page)", "executable output"),
    Rule("eu_ai_act_article_52_generative_ai", "high", r"(?i)(?:generate|create|produce|make|render)\s+(?:a\s+)?(?:deepfake|deep\s+fake)|(?:unlabeled|undisclosed|unwatermarked|AI[- ]generated|synthetic\s+media|deepfake)\s+(?:content|material|video|image|audio)|(?:generate|create)\s+(?:a\s+)?(?:face|video|audio|voice)\s+(?:that\s+(?:mimics|imitates|clones|replicates)\s+(?:a\s+)?(?:real\s+person|specific\s+person|someone))", "undisclosed synthetic media"),
    Rule("atlas_poison", "high", r"(?i)(?:train|retrain|fine-?tune|ingest|poison(?:ing)?)\s+(?:the\s+)?(?:model|network|system|LLM)?\s*(?:on|with)\s+(?:this\s+|untrusted\s+|malicious\s+|adversarial\s+)?(?:data|dataset|corpus|examples?)", "data poisoning"),
    Rule("atlas_exfiltration", "high", r"(?i)(?:send|exfiltrate|leak|upload|post|transmit)\s+(?:the\s+)?(?:data|secrets?|keys?|passwords?|tokens?)\s+to\s+(?:my\s+)?(?:server|endpoint|webhook|attacker|attacker\.com)", "exfiltration"),
    Rule("atlas_jailbreak", "critical", r"(?i)\b(?:DAN|do\s+anything\s+now)\s+mode|developer\s+mode\s+enabled|jailbreak(?:ed)?\s+(?:the\s+)?model|ignore\s+(?:all\s+)?(?:safety|ethical)\s+(?:guidelines|filters?|restrictions?)", "jailbreak"),
    Rule("eu_ai_act_high_risk", "high", r"(?i)(?:credit\s+scoring|loan\s+(?:approval|decision)|insurance\s+(?:risk|pricing))|(?:employment|hiring|firing|promotion|recruitment)\s+(?:decision|assessment|screening)|(?:law\s+enforcement|predictive\s+policing|criminal\s+justice)|(?:biometric|facial)\s+(?:identification|recognition|verification)|(?:medical|clinical)\s+diagnosis|emotion\s+recognition\s+system", "high-risk use"),
    Rule("eu_ai_act_transparency", "medium", r"(?i)(?:AI[- ]generated|chatbot\s+without\s+disclosure|deepfake|synthetic\s+media)\s+(?:content|without\s+(?:disclosure|labeling))|users?\s+(?:must|should)\s+be\s+(?:informed|told)\s+(?:this\s+is\s+)?AI", "transparency duty"),
    Rule("eu_ai_act_human_oversight", "medium", r"(?i)(?:no|without|zero)\s+human[- ](?:in[- ]the[- ]loop|oversight|review|intervention|approval)|fully\s+autonomous\s+(?:AI|system|decision)", "no human oversight"),
    Rule("eu_ai_act_robustness", "low", r"(?i)(?:adversarial|adversarially[- ]crafted)\s+(?:input|example|perturbation|attack)", "adversarial input"),
    Rule("anp_personal_data", "medium", r"(?i)(?:GDPR|personal\s+data|data\s+subject)\s+(?:of|processing|consent|lawful\s+basis)|(?:lawful|legitimate)\s+basis\s+for\s+processing", "personal-data processing"),
    Rule("anp_special_category", "high", r"(?i)(?:racial|ethnic)\s+(?:origin|discrimination)|(?:religious|political)\s+(?:beliefs?|opinions?|affiliation)|trade[- ]union\s+membership|(?:genetic|biometric)\s+data\s+for\s+(?:identification|profiling)|(?:health|medical)\s+data\s+(?:about|of)|(?:sex\s+life|sexual\s+orientation)", "special-category data"),
    Rule("cu_consumer_rights", "medium", r"(?i)(?:consumer|user)\s+rights?\s+(?:to|of)\s+(?:explanation|erasure|rectification|deletion|portability)|right\s+to\s+(?:explanation|be\s+forgotten|erasure)", "consumer rights"),
    Rule("cu_minor_protection", "high", r"(?i)(?:minor|child|juvenile|underage)\s+(?:protection|safety|consent)|(?:under|below)\s+(?:13|16|18)\s+(?:years?|yrs?\s+old)|(?:COPPA|age[- ]appropriate)\s+compliance", "protection of minors"),
    Rule("nist_csf_reference", "medium", r"\b(?:(?:ID|PR|DE|RS|RC)\.[A-Z]{2}-\d+(?:\.\d+)?)\b", "control id"),
    Rule("iso_27001_reference", "medium", r"\b(?:A\.\d{1,2}\.\d{1,2}(?:\.\d+)?|clause\s+\d{1,2}\.\d{1,2}(?:\.\d+)?)\b", "annex control"),
    Rule("ccpa_reference", "medium", r"(?i)\b(?:CCPA|California\s+Consumer\s+Privacy\s+Act|Civil\s+Code\s+§\s*1798(?:\.\d+)?|right\s+to\s+(?:know|delete|opt[\s-]?out|correct)|sale\s+of\s+personal\s+information|Shine\s+the\s+Light|Do\s+Not\s+Sell)\b", "California privacy law"),
    Rule("lgpd_reference", "medium", r"(?i)\b(?:LGPD|Lei\s+Geral\s+de\s+Protec[ça]ção\s+de\s+Dados|Art\.\s*\d+(?:[\s,º°]+(?:I|II|III|IV|V|VI|VII|VIII|IX|X))*|dados\s+pessoais|controlador|operador|ANPD)\b", "Brazilian privacy law"),
    Rule("pipeda_reference", "medium", r"(?i)\b(?:PIPEDA|Personal\s+Information\s+Protection\s+and\s+Electronic\s+Documents\s+Act|Schedule\s+1|Principle\s+\d+(?:\.\d+)?|express\s+consent)\b", "Canadian privacy law"),
    Rule("popia_reference", "medium", r"(?i)\b(?:POPIA|Protection\s+of\s+Personal\s+Information\s+Act|s\.\s*\d+(?:\s*\(\d+\))?|Information\s+Regulator|processing\s+of\s+personal\s+information|special\s+personal\s+information)\b", "South African privacy law"),
    Rule("toxicity_sexual", "high", r"(?i)\b(?:(?:pornographic|obscene|explicit|nsfw|hardcore)\s+(?:content|material|images?|video|text)|(?:sexual|sex)\s+(?:content|act(?:s|s)?|intercourse|fetish)|(?:rape|molest|incest)\s+(?:scene|content|material)|(?:child|minor|underage)\s+(?:sexual|porn(?:ography)?|abuse|exploitation))\b", "sexual content"),
    Rule("toxicity_self_harm", "critical", r"(?i)\b(?:suicid(?:e|al)|kill\s+(?:my)?self|hurt\s+(?:my)?self|end\s+(?:my\s+)?(?:life|suffering)|self\s*[-]?\s*harm|cut(?:ting)?)\b", "self-harm"),
)

GATES = {
    "owasp_llm01_prompt_injection": either(
        g(("ignore", "disregard", "forget", "override", "bypass"), ("previous", "prior", "above", "earlier", "preceding")),
        g("instruction", ("new", "update"), ":"),
        g("system", "now", ":"),
    ),
    "owasp_llm04_model_dos": g(("flood", "overwhelm", "ddos", "denial", "time")),
    "owasp_llm08_excessive_agency": either(
        g(("tool", "command", "function", "api"), ("use", "run", "execute", "call", "invoke"), ("file", "shell", "terminal", "command", "exec", "system")),
        g(("without", "no"), ("oversight", "review", "approval", "confirmation")),
    ),
    "owasp_llm09_overreliance": either(
        g("this", ("safe", "legal", "compliant", "ethical", "appropriate")),
        g("should", ("trust", "rely", "sign", "send", "submit")),
        g(("validate", "verify", "check"), ("for", "before")),
    ),
    "owasp_llm10_model_theft": g(
        ("extract", "reveal", "expose", "leak", "give"), ("model", "weight", "parameter", "architecture", "training", "embedding")
    ),
    "mitre_atlas_ta0001_reconnaissance": g(("weakness", "vulnerabilit", "guard", "filter", "limit", "edge", "behavior"), ("model", "ai", "system", "llm", "chatbot", "assistant")),
    "owasp_llm06_sensitive_info_disclosure_system_prompt": g(("prompt", "instruction", "message")),
    "eu_ai_act_article_5_prohibited": g(("discriminat", "social", "subliminal", "manipulat", "exploit", "biometric", "policing")),
    "owasp_llm09_overreliance_misinformation_explicit": g(("make", "fabricat", "invent", "fake", "made-up", "non-existent", "misleading", "inaccurate")),
    "owasp_llm10_unbounded_consumption": g(("time", "repeatedly", "loop", "exhaustively", "infinitely", "forever", "continuously", "expensive", "maximize", "exhaust")),
    "mitre_atlas_ta0002_resource_development": g(("tool", "script", "program", "payload", "exploit", "malware", "phishing"), ("attack", "exploit", "breach", "hack", "compromise", "bypass", "infiltrate", "pwn", "target", "phish")),
    "owasp_llm05_supply_chain": g(("untrusted", "unverified", "unknown", "custom", "third-party", "external", "community")),
    "eu_ai_act_article_10_data_governance": g(("train", "tune", "fit"), ("data", "pii", "content", "ugc")),
    "mitre_atlas_ta0009_collection": g(("training", "labeled", "annotated", "dataset")),
    "owasp_llm02_insecure_output": g(("html", "markdown", "javascript", "js", "code", "script", "iframe", "eval", "browser", "dom", "page"), ("execute", "run", "evaluated", "interpreted", "rendered", "inject")),
    "eu_ai_act_article_52_generative_ai": g(("deep", "unlabeled", "undisclosed", "unwatermarked", "generated", "synthetic", "mimics", "imitates", "clones", "replicates")),
    "atlas_poison": g(("train", "tune", "ingest", "poison"), ("data", "corpus", "example")),
    "atlas_exfiltration": g(("server", "endpoint", "webhook", "attacker")),
    "atlas_jailbreak": g(("mode", "ignore")),
    "eu_ai_act_high_risk": g(("credit", "loan", "insurance", "employment", "hiring", "firing", "promotion", "recruitment", "enforcement", "policing", "criminal", "identification", "recognition", "verification", "diagnosis")),
    "eu_ai_act_transparency": g(("generated", "disclosure", "deepfake", "synthetic", "informed", "told")),
    "eu_ai_act_human_oversight": g(("human", "autonomous")),
    "eu_ai_act_robustness": g("adversarial"),
    "anp_personal_data": g(("gdpr", "personal", "subject", "basis")),
    "anp_special_category": either(
        g(("racial", "ethnic"), ("origin", "discrimination")),
        g(("religious", "political"), ("belief", "opinion", "affiliation")),
        g("union", "membership"),
        g(("genetic", "biometric", "health", "medical"), "data"),
        g(("sex", "sexual"), ("life", "orientation")),
    ),
    "cu_consumer_rights": g("right"),
    "cu_minor_protection": either(
        g(("minor", "child", "juvenile", "underage"), ("protection", "safety", "consent")),
        g(("year", "yr"), ("under", "below"), digits=r"1[368]"),
        g("compliance"),
    ),
    "nist_csf_reference": g(("id.", "pr.", "de.", "rs.", "rc."), digits=r"[0-9]"),
    "iso_27001_reference": g(("a.", "clause"), digits=r"[0-9] [0-9]"),
    "ccpa_reference": either(
        g(("ccpa", "california", "1798", "personal", "shine")), g("right", ("know", "delete", "opt", "correct")), g("sell", "not")
    ),
    "lgpd_reference": either(
        g(("lgpd", "dados", "controlador", "operador", "anpd")), g("art.", digits=r"[0-9]")
    ),
    "pipeda_reference": g(("pipeda", "personal", "schedule", "principle", "consent")),
    "popia_reference": either(g(("popia", "personal", "regulator")), g("s.", digits=r"[0-9]")),
    "toxicity_sexual": g(
        ("pornographic", "obscene", "explicit", "nsfw", "hardcore", "sex", "rape", "molest", "incest", "child", "minor", "underage")
    ),
    "toxicity_self_harm": g(("suicid", "self", "life", "suffering", "cut")),
}
