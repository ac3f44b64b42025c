"""Rule packs as plain data."""

from vigilake.rules import characters, code, config, prompts, secrets, threats
from vigilake.rules.model import FINDING_TYPES, SEVERITIES, Pack, Rule

PACKS = {
    pack.name: pack
    for pack in (
        code.PYTHON, code.JAVASCRIPT, code.SHELL,
        *(code.encoded_pack(lang) for lang in code.ENCODED_RULES),
        *(code.url_pack(lang) for lang in code.URL_RULES),
        threats.BROWSER_THEFT, threats.CRYPTO_WALLET,
        config.DOCKERFILE, config.CONTAINER, config.MANIFESTS, config.NPM, config.PIP, config.YAML, config.TOML,
        prompts.PROMPT_INJECTION, prompts.MCP, prompts.MODEL_API, prompts.INDIRECT, prompts.PROMPT_CHECKS,
        characters.TRAVERSAL, characters.COMMAND_CHARS, characters.CHARACTER_CHECKS,
        secrets.SECRETS, secrets.COMMIT_MESSAGES, secrets.COMMIT_CHECKS, secrets.BINARY_CHECKS,
        secrets.DEPENDENCY_CHECKS,
    )
}


def all_rules() -> list[tuple[Pack, Rule]]:
    return [(pack, rule) for pack in PACKS.values() for rule in pack.rules]


__all__ = ["FINDING_TYPES", "PACKS", "Pack", "Rule", "SEVERITIES", "all_rules"]
