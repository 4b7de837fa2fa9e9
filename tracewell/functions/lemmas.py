"""Irregular English forms and their base forms, used to widen queries."""

from __future__ import annotations

#: Base form of each irregular form, in alphabetical order of the forms.
LEMMAS: dict[str, str] = {
    "arisen": "arise", "arose": "arise", "ate": "eat", "awoke": "awake", "awoken": "awake", "beaten": "beat", "became": "become", "been": "be",
    "befell": "befall", "begun": "begin", "bent": "bend", "bereft": "bereave", "besought": "beseech", "bit": "bite", "bitten": "bite",
    "bled": "bleed", "blew": "blow", "blown": "blow", "bore": "bear", "born": "bear", "borne": "bear", "bought": "buy", "bound": "bind",
    "bred": "breed", "broke": "break", "broken": "break", "brought": "bring", "built": "build", "came": "come", "caught": "catch", "chose": "choose",
    "chosen": "choose", "clung": "cling", "dealt": "deal", "did": "do", "done": "do", "drank": "drink", "drawn": "draw", "drew": "draw",
    "driven": "drive", "drove": "drive", "drunk": "drink", "dwelt": "dwell", "eaten": "eat", "fallen": "fall", "fed": "feed", "fell": "fall",
    "felt": "feel", "fled": "flee", "flew": "fly", "flown": "fly", "flung": "fling", "forbade": "forbid", "forbidden": "forbid", "forgave": "forgive",
    "forgiven": "forgive", "forgot": "forget", "forgotten": "forget", "forsaken": "forsake", "forsook": "forsake", "found": "find", "froze": "freeze",
    "frozen": "freeze", "gave": "give", "given": "give", "gone": "go", "got": "get", "gotten": "get", "grew": "grow", "grown": "grow", "had": "have",
    "has": "have", "heard": "hear", "held": "hold", "hid": "hide", "hidden": "hide", "kept": "keep", "knelt": "kneel", "knew": "know",
    "known": "know", "laid": "lay", "lain": "lie", "lay": "lie", "led": "lead", "left": "leave", "lent": "lend", "lost": "lose", "made": "make",
    "meant": "mean", "met": "meet", "misled": "mislead", "mistaken": "mistake", "mistook": "mistake", "paid": "pay", "pled": "plead",
    "proven": "prove", "ran": "run", "rang": "ring", "ridden": "ride", "risen": "rise", "rode": "ride", "rose": "rise", "rung": "ring", "said": "say",
    "sang": "sing", "sat": "sit", "saw": "see", "seen": "see", "shaken": "shake", "shone": "shine", "shook": "shake", "shrank": "shrink",
    "shrunk": "shrink", "slain": "slay", "slew": "slay", "slid": "slide", "smelt": "smell", "sold": "sell", "sought": "seek", "sown": "sow",
    "sped": "speed", "spent": "spend", "spoke": "speak", "spoken": "speak", "sprang": "spring", "sprung": "spring", "spun": "spin", "stole": "steal",
    "stolen": "steal", "stood": "stand", "stove": "stave", "stricken": "strike", "striven": "strive", "strove": "strive", "struck": "strike",
    "strung": "string", "stuck": "stick", "stung": "sting", "stunk": "stink", "swam": "swim", "swept": "sweep", "swollen": "swell", "sworn": "swear",
    "swum": "swim", "swung": "swing", "taken": "take", "taught": "teach", "thought": "think", "threw": "throw", "thrown": "throw", "told": "tell",
    "took": "take", "tore": "tear", "torn": "tear", "understood": "understand", "went": "go", "wept": "weep", "were": "be", "withdrawn": "withdraw",
    "withdrew": "withdraw", "woke": "wake", "woken": "wake", "won": "win", "wore": "wear", "worn": "wear", "wound": "wind", "wove": "weave",
    "woven": "weave", "written": "write", "wrote": "write", "wrung": "wring",
}
