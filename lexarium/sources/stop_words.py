"""Stop words of the queries over the test tables: frequent short words of four languages (fixed values)."""

STOP_WORDS = tuple(
    """
    a about after all an and any are as at be been but by can could did do for from had has have he her his how i if in into is it
    its like more my no not of on or our out she so some than that the their them then there these they this to up was we were what
    when which who will with would you your
    au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous
    auf aus bei das dem den der des die ein eine einen einer es für ich im ist mit nicht sich sie sind und von war wie zu zum zur
    al con de del el ella en es esta este la las lo los más mi muy no o para pero por que se si sin su sus un una y
    """.split()
)
