"""French stop words in upper case."""

# The list that Spark's StopWordsRemover ships for French.
FRENCH = tuple(
    """
    AU AUX AVEC CE CES DANS DE DES DU ELLE EN ET EUX IL JE LA LE LES LEUR LUI MA MAIS ME MÊME
    MES MOI MON NE NOS NOTRE NOUS ON OU PAR PAS POUR QU QUE QUI SA SE SES SON SUR TA TE TES TOI
    TON TU UN UNE VOS VOTRE VOUS C D J L À M N S T Y ÉTÉ ÉTÉE ÉTÉES ÉTÉS ÉTANT ÉTANTE ÉTANTS
    ÉTANTES SUIS ES EST SOMMES ÊTES SONT SERAI SERAS SERA SERONS SEREZ SERONT SERAIS SERAIT
    SERIONS SERIEZ SERAIENT ÉTAIS ÉTAIT ÉTIONS ÉTIEZ ÉTAIENT FUS FUT FÛMES FÛTES FURENT SOIS
    SOIT SOYONS SOYEZ SOIENT FUSSE FUSSES FÛT FUSSIONS FUSSIEZ FUSSENT AYANT AYANTE AYANTES
    AYANTS EU EUE EUES EUS AI AS AVONS AVEZ ONT AURAI AURAS AURA AURONS AUREZ AURONT AURAIS
    AURAIT AURIONS AURIEZ AURAIENT AVAIS AVAIT AVIONS AVIEZ AVAIENT EUT EÛMES EÛTES EURENT AIE
    AIES AIT AYONS AYEZ AIENT EUSSE EUSSES EÛT EUSSIONS EUSSIEZ EUSSENT
    """.split()
)
