"""Stop words by language; a small public list of function words for each."""

_LISTS = {
    "english": "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves",
    "german": "aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des die dies doch dort du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann kein mein mit nach nicht noch nun nur ob oder sehr sein sich sie sind so um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur über",
    "french": "à au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous y été être",
    "spanish": "a al algo como con cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto ha hasta hay la las le les lo los más me mi muy no nos o otra otro para pero por que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo",
    "italian": "a ai al alla anche che chi ci come con da dei del della di e è gli ha i il in io la le lei lo lui ma mi nel nella no noi non o per più quando questo se si sono su tra tu un una uno voi",
    "portuguese": "a ao as até com como da das de do dos e ela ele em entre era essa esse esta este eu foi já mais mas me meu muito na não nas no nos o os ou para pela pelo por qual quando que quem se sem ser seu sua também te tem um uma você",
    "dutch": "aan als bij dan dat de der deze die dit door een en er haar had heb het hij hoe hun ik in is je kan maar me met mijn naar niet nog nu of om onder ook op over te tot uit van voor was wat we wel wie wij zij zijn zo zou",
}
STOP_WORDS = {name: frozenset(words.split()) for name, words in _LISTS.items()}
ENGLISH = STOP_WORDS["english"]
UNIVERSAL = frozenset().union(*STOP_WORDS.values())
