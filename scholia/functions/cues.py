"""Cues of review sentences, by risk code, as (weight, pattern); case is ignored."""

DETECT = {
    "R1": [
        (2, r"\b(?:claim|claims|claimed|conclusion|statement)s?\b[^.]{0,90}\b(?:not (?:correct|true|supported|justified|convincing)|too strong|overstat\w*|overclaim\w*|unsupported|not backed)"),
        (2, r"\b(?:not|hardly|insufficiently)\s+(?:convincing|compelling)\b"),
        (2, r"\b(?:proof|theorem|lemma|derivation|equation|proposition)\b[^.]{0,80}\b(?:incorrect|wrong|flaw\w*|not (?:valid|correct|rigorous)|error|gap|does not hold)"),
        (2, r"\bassumptions?\b[^.]{0,70}\b(?:too strong|unrealistic|not (?:verified|justified|checked|validated)|questionable|restrictive)"),
        (2, r"\b(?:does|do|did)\s+not\s+(?:support|demonstrate|show|prove|establish|justify)\b"),
        (2, r"\bnot\s+(?:well\s+)?justified\b"),
        (2, r"\bevidence\b[^.]{0,60}\b(?:weak|insufficient|not enough|lacking)"),
        (2, r"\b(?:I|we)\s+(?:am|are)\s+not\s+convinced\b"),
        (2, r"\bnot\s+sufficient\s+evidence\b"),
    ],
    "R2": [
        (1, r"\bbaselines?\b"),
        (2, r"\bbaselines?\b[^.]{0,80}\b(?:weak|simple|old|outdated|missing|not (?:included|compared)|stronger|more recent)"),
        (2, r"\bablation(?:s|\s+stud(?:y|ies)|\s+experiments?)?\b"),
        (2, r"\b(?:error bars?|standard deviations?|confidence intervals?|95% CI)\b"),
        (2, r"\b(?:multiple|several|different|random)\s+seeds?\b|\bsingle\s+(?:seed|run)\b"),
        (2, r"\bvarian\w+\b[^.]{0,60}\b(?:not reported|missing|unclear|should|analysis)"),
        (2, r"\bstatistical(?:ly)?\s+(?:significan\w+|test\w*)|\bp-values?\b|\bsignificance test"),
        (2, r"\b(?:improvements?|gains?|differences?|margins?)\b[^.]{0,60}\b(?:marginal|negligible|within (?:the )?(?:noise|error|std)|not significant|too small)"),
        (2, r"\bhyper-?parameters?\b[^.]{0,90}\b(?:fair|same budget|equally|grid search|tuned|how (?:were|was)|chosen)"),
        (2, r"\b(?:metrics?|evaluation measures?)\b[^.]{0,70}\b(?:not (?:appropriate|suitable|standard|meaningful)|misleading|does not (?:capture|reflect))"),
        (2, r"\bfair\s+comparison\b"),
        (2, r"\b(?:more|additional|further)\s+(?:experiments?|evaluations?|datasets?|benchmarks?|ablations?)\b"),
        (2, r"\bexperiments?\b[^.]{0,60}\b(?:do|does|did)\s+not\s+(?:conclusively\s+)?(?:show|demonstrate|support|establish)"),
    ],
    "R3": [
        (2, r"\b(?:data|information|label|test)\s+leak(?:age|s|ed|ing)?\b"),
        (2, r"\bleak(?:age|ed|ing)\b"),
        (2, r"\bcontaminat(?:ion|ed|es)\b"),
        (2, r"\b(?:train|training)[-/ ](?:and[- ])?(?:test|validation|val)\b[^.]{0,60}\b(?:split|overlap|leak|contaminat|same|shared)"),
        (2, r"\b(?:test|held[- ]?out)\s+(?:set|data|samples?)\b[^.]{0,70}\b(?:appear|occur|seen|during training)"),
        (2, r"\b(?:randomly\s+split|random\s+split|scaffold split|temporal split|cluster split|leave[- ]one[- ]cluster[- ]out|group k-?fold)\b"),
        (2, r"\b(?:duplicate|near[- ]duplicate|redundan\w+)\b[^.]{0,60}\b(?:train|test|dataset|samples?|structures?)"),
        (2, r"\bpre-?process\w*\b[^.]{0,60}\b(?:before|prior to|whole|entire|full)\s+(?:the\s+)?(?:split|dataset|data)"),
        (2, r"\bnormali[sz]\w+\b[^.]{0,50}\b(?:entire|whole|full)\s+dataset"),
    ],
    "R4": [
        (2, r"\b(?:data|dataset)\s+(?:quality|collection|curation|provenance|acquisition)\b"),
        (2, r"\bhow (?:was|were) the (?:data|dataset)\b"),
        (2, r"\b(?:label|annotation|ground[- ]truth)\w*\b[^.]{0,70}\b(?:noise|noisy|quality|errors?|reliab\w+|inconsist\w+|inter-?annotator)"),
        (2, r"\b(?:small|limited|insufficient|tiny|few)\b[^.]{0,45}\b(?:dataset|data|sample size|number of (?:samples|examples|subjects|patients))"),
        (2, r"\b(?:sample size|statistical power|underpowered|power analysis)\b"),
        (2, r"\b(?:missing (?:values?|data)|imputat\w+)\b"),
        (2, r"\b(?:different|inconsistent|varying|heterogeneous)\s+(?:sources?|labs?|protocols?|conditions?|instruments?|sites?|batches?)\b"),
        (2, r"\b(?:publication bias|survivorship bias|selection bias)\b"),
        (2, r"\b(?:batch effects?|confound(?:er|ers|ing|ed)?)\b"),
        (2, r"\b(?:negative|positive|appropriate|proper)\s+controls?\b"),
    ],
    "R5": [
        (2, r"\breproduc(?:e|ible|ibility|ing)\b|\breplicab\w+"),
        (2, r"\b(?:code|implementation|source code)\b[^.]{0,70}\b(?:not (?:available|released|provided|public)|will (?:be )?(?:released?|provided)|be (?:made )?(?:public|available)|open[- ]source)"),
        (2, r"\b(?:implementation|experimental|training)\s+details?\b[^.]{0,60}\b(?:missing|not (?:provided|given|reported)|unclear|lack\w*)"),
        (2, r"\b(?:hyper-?parameters?|learning rate|batch size|number of epochs)\b[^.]{0,60}\b(?:not (?:reported|specified|given|provided)|missing|unclear)"),
        (2, r"\b(?:training|inference|computational|runtime|memory|GPU)\b[^.]{0,45}\b(?:cost|budget|time|overhead|requirements?|hours?)\b[^.]{0,60}\b(?:not (?:reported|provided|discussed)|missing|unclear|should)"),
        (2, r"\b(?:dataset|data)\b[^.]{0,50}\b(?:not (?:available|released|shared)|cannot be (?:accessed|obtained))"),
        (2, r"\bopen[- ]?sourc\w+\b"),
        (2, r"\b(?:details?|information)\b[^.]{0,45}\b(?:are|is)\s+missing\b"),
    ],
    "R6": [
        (2, r"\bnovelt(?:y|ies)\b"),
        (2, r"\bincremental\b"),
        (2, r"\b(?:contribution|novelty)s?\b[^.]{0,60}\b(?:limited|marginal|minor|narrow|unclear|not (?:clear|significant|enough))"),
        (2, r"\b(?:already|previously)\s+(?:known|proposed|shown|studied|explored)\b"),
        (2, r"\b(?:similar|close|identical)\s+to\b[^.]{0,60}\b(?:existing|prior|previous)\s+(?:work|method|approach)"),
        (2, r"\brelated work\b[^.]{0,70}\b(?:missing|incomplete|omit\w*|not (?:discussed|cited)|should (?:include|discuss|cite))"),
        (2, r"\b(?:missing|omitted|overlooked|not cited|fail(?:s|ed)? to cite)\b[^.]{0,70}\b(?:work|literature|papers?|references?|citations?)"),
        (2, r"\b(?:should|could|must)\s+(?:cite|compare (?:with|to)|discuss)\b"),
        (2, r"\bhow does\b[^.]{0,60}\bcompare (?:to|with)\b"),
    ],
    "R7": [
        (1, r"\bgenerali[sz](?:e|es|ed|ation|ability|able)\b"),
        (2, r"\bgenerali[sz]\w*\b[^.]{0,60}\b(?:to (?:other|new|unseen|real|larger|different)|beyond|unclear|not (?:clear|shown|evaluated)|question)"),
        (2, r"\b(?:out[- ]of[- ]distribution|OOD|distribution shift|domain shift|covariate shift)\b"),
        (2, r"\bextrapolat\w+"),
        (2, r"\bapplicability domain\b|\bdomain of applicability\b"),
        (2, r"\blimitations?\b[^.]{0,70}\b(?:not (?:discussed|stated|addressed|acknowledged)|missing|should be (?:discussed|added))"),
        (2, r"\b(?:only|just)\s+(?:evaluated|tested|validated|demonstrated)\s+(?:on|in|for)\b"),
        (2, r"\b(?:real[- ]world|practical|deployment|clinical)\b[^.]{0,60}\b(?:setting|scenario|applicab\w+|unclear|not (?:clear|shown|evaluated))"),
        (2, r"\b(?:does|do)\s+not\s+(?:apply|hold|transfer|generali[sz]e)\b"),
        (1, r"\b(?:unseen|other|different)\s+(?:domains?|datasets?|distributions?|species|chemistries|materials)\b"),
    ],
    "R8": [
        (2, r"\b(?:DFT|density functional|molecular dynamics|force ?field|first[- ]principles|ab initio)\b"),
        (2, r"\b(?:synthesizab\w+|synthetic accessibility|retrosynthe\w+)\b"),
        (2, r"\b(?:thermodynamic|phase)\s+stab\w+|\bformation energy\b|\benergy above (?:the )?hull\b|\bconvex hull\b"),
        (2, r"\b(?:wet[- ]?lab|in vitro|in vivo|bench(?:top)?\s+experiments?)\b"),
        (1, r"\bexperimental(?:ly)?\s+(?:valid\w+|verif\w+|confirm\w+)\b"),
        (2, r"\b(?:charge neutrality|valence|oxidation state|stoichiometr\w+|space group|crystal structure)\b"),
        (2, r"\b(?:physical(?:ly)?|chemical(?:ly)?)\s+(?:plausib\w+|realistic|meaningful|consistent|implausib\w+)\b"),
        (2, r"\b(?:ionic conductivity|electrochemical (?:stability )?window|viscosity|interfacial stab\w+|cycle life)\b"),
    ],
    "R0": [
        (2, r"\b(?:typos?|grammar|grammatical|spelling)\b"),
        (2, r"\b(?:hard|difficult)\s+to\s+(?:read|follow|parse|understand)\b"),
        (2, r"\b(?:writing|presentation|notation|wording|phrasing)\b[^.]{0,50}\b(?:unclear|confusing|poor|improve|inconsistent)"),
        (2, r"\b(?:figure|fig\.|table|caption|axis|legend)\b[^.]{0,50}\b(?:unclear|confusing|missing label|hard to read|too small)"),
        (2, r"\b(?:section|paragraph|sentence)\b[^.]{0,40}\b(?:unclear|confusing|should be (?:moved|rewritten|shortened))"),
    ],
}

REJECT = {
    "R1": [(2, r"\b(?:claims?|conclusions?)\b[^.]{0,40}\b(?:well[- ]supported|convincing|sound|solid)")],
    "R2": [
        (2, r"\bablation\s+stud(?:y|ies)\s+(?:is|are)\s+(?:thorough|comprehensive|convincing|extensive)"),
        (2, r"\b(?:strong|extensive|comprehensive|solid)\s+(?:baselines?|experiments?|evaluation)\b"),
    ],
    "R3": [(2, r"\b(?:gradient|memory|activation|privacy|parameter)\s+leak(?:age)?\b"), (2, r"\bleaky\s*ReLU\b")],
    "R4": [(2, r"\bcontrol (?:variate|flow|theory|signal|policy)\b"), (2, r"\bNegative results do not necessarily mean\b")],
    "R5": [(2, r"\bcode (?:is|was) (?:provided|available|released)\b(?![^.]{0,40}\bnot\b)")],
    "R6": [
        (2, r"\b(?:novel|novelty)\b[^.]{0,40}\b(?:is clear|is significant|is high|and interesting|and important)"),
        (2, r"\bto (?:the )?best of my knowledge[^.]{0,40}\b(?:novel|new|first)\b"),
    ],
    "R7": [
        (2, r"\bgenerali[sz]es? well\b|\bstrong generali[sz]ation\b"),
        (2, r"\bgenerali[sz]ation\s+(?:error|gap|bounds?|theory)\b"),
    ],
    "R8": [
        (2, r"\b(?:image|speech|audio|video|text|data|program|code|scene|motion|view)\s+synthesis\b"),
        (2, r"\bDFT\s+(?:matrix|transform|coefficients?|basis)\b|\bFourier\s+transform\b"),
    ],
    "R0": [
        (2, r"\bunclear\b[^.]{0,60}\b(?:how (?:the )?(?:model|method|algorithm) (?:is|was) (?:implement|train|initiali[sz])|hyper-?parameter|experimental setup)"),
    ],
}

SECTION_POLARITY = {
    "strength": "positive", "strengths": "positive", "pros": "positive",
    "weakness": "negative", "weaknesses": "negative", "cons": "negative", "limitation": "negative",
    "limitations": "negative", "concern": "negative", "concerns": "negative",
    "question": "neutral", "questions": "neutral", "summary": "neutral",
}

NEGATIVE = r"\b(?:not|no|lack\w*|missing|unclear|weak\w*|limited|insufficient|concern\w*|however|should|fail\w*|problem\w*|issue\w*|question\w*|doubt\w*|confus\w*|unfortunately|incorrect|wrong|outdated|only)\b|\?"
POSITIVE = r"\b(?:well[- ]written|clear|strong|convincing|novel|interesting|thorough|impressive|good|nice|solid|comprehensive|extensive|important|significant contribution|easy to follow|appreciate)\b"
