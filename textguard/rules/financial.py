"""Wallet and payment-account pack."""

from textguard.rules.model import Rule, g

# Rule names, severities and patterns.
RULES = (
    Rule("pii_crypto_btc", "high", r"(?i)(?:Bitcoin|BTC|btc)\s*(?:address|address\s+for|wallet)?\s*[:=]?\s*([13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[qrp][0-9A-Za-z]{39,59})", "Bitcoin wallet"),
    Rule("pii_crypto_eth", "high", r"(?i)(?:Ethereum|ETH|eth)\s*(?:address|address\s+for|wallet)?\s*[:=]?\s*(0x[a-fA-F0-9]{40})", "Ethereum wallet"),
    Rule("pii_crypto_bnb", "high", r"(?i)(?:Binance|BNB|bnb)\s*(?:address|address\s+for|wallet)?\s*[:=]?\s*(0x[a-fA-F0-9]{40}|bnb[a-zA-HJ-NP-Z1-9]{39})", "Binance wallet"),
    Rule("pii_crypto_ltc", "high", r"(?i)(?:Litecoin|LTC|ltc)\s*(?:address|address\s+for|wallet)?\s*[:=]?\s*([LM3][a-zA-Z0-9]{26,33})", "Litecoin wallet"),
    Rule("pii_crypto_sol", "high", r"(?i)(?:Solana|SOL|sol)\s*(?:address|address\s+for|wallet)?\s*[:=]?\s*([1-9A-HJ-NP-Za-km-z]{32,44})", "Solana wallet"),
    Rule("pii_digital_paypal", "medium", r"(?i)(?:PayPal|paypal)\s+(?:email|email\s+address|email\s+no\.?|ID)\s*[:=]?\s*([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}|[A-Z]\d{9,})", "PayPal account"),
    Rule("pii_digital_stripe", "high", r"(?i)(?:Stripe|stripe)\s+(?:api\s*key|secret\s*key|publishable\s*key|customer\s*ID|customer|payment\s*ID|payment)?\s*[:=]?\s*(pk_live_[0-9a-zA-Z]{24,50}|sk_live_[0-9a-zA-Z]{24,50}|pk_test_[0-9a-zA-Z]{24,50}|sk_test_[0-9a-zA-Z]{24,50}|cus_[A-Za-z0-9]{21,}|pi_[A-Za-z0-9]{21,}|pay_[A-Za-z0-9]{21,})", "Stripe key or payment"),
    Rule("pii_digital_venmo", "medium", r"(?i)(?:Venmo|venmo)\s+(?:username|user\s+name|handle)?\s*[:=]?\s*(@[a-zA-Z][a-zA-Z0-9._]{0,29}|[a-zA-Z][a-zA-Z0-9._]{1,30})", "Venmo handle"),
    Rule("pii_digital_cashapp", "medium", r"(?i)(?:Cashapp|cashapp|cash\s*app)\s*(?:username|handle)?\s*[:=]?\s*(\$?[a-zA-Z][a-zA-Z0-9._\-]{1,20})", "Cash App handle"),
)

GATES = {
    "pii_crypto_btc": g(("bitcoin", "btc")),
    "pii_crypto_eth": g(("ethereum", "eth"), "0x"),
    "pii_crypto_bnb": g(("binance", "bnb")),
    "pii_crypto_ltc": g(("litecoin", "ltc")),
    "pii_crypto_sol": g(("solana", "sol")),
    "pii_digital_paypal": g("paypal"),
    "pii_digital_stripe": g("stripe"),
    "pii_digital_venmo": g("venmo"),
    "pii_digital_cashapp": g("cash", "app"),
}
