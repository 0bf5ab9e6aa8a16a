"""The word lists of the register features."""

# Fixed values that results depend on: function words of standard English, by kind.
STANDARD = """
a an the this that these those such no every each any all some both either neither much many more most few less least own same
other another
i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves who whom whose which what whatever whoever whomever whichever
of in on at by for with about against between into through during before after above below to from up down over under again then
once here there when where why how as until while than upon within without amid amidst among amongst beneath beside beyond toward
towards throughout
and but or nor so yet if because although though whereas whether unless since lest
be am is are was were been being have has had having do does did doing will would shall should may might must can could ought
not only even just also too very ever never
""".split()

# Archaic forms that count as function words.
ARCHAIC = """
thou thee thy thine ye hath doth dost hast art wert wast wilt shalt canst couldst wouldst shouldst didst hadst mayest mayst unto
verily whilst wherefore whence whither hither thither thence hence thereof therein thereto thereon thereby therewith thereunto
wherein whereof whereby whereupon wherewith herein hereof hereby hereunto withal nay yea
""".split()

# Register markers, matched as whole words and with their case.
MARKERS = "thou thee thy thine art hast hath dost doth shalt wilt unto ye O".split()

FUNCTION_WORDS = sorted({*STANDARD, *ARCHAIC})
