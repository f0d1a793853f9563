"""Known results of the two keyword reports."""

# Hashtag, sentiment, total.
SENTIMENT_TOTALS = """\
daca,negative,5
daca,neutral,20
daca,positive,9
guncontrol,negative,34
guncontrol,neutral,126
guncontrol,positive,94
gunsense,negative,47
gunsense,neutral,290
gunsense,positive,93
healthcare,negative,367
healthcare,neutral,3616
healthcare,positive,1670
medicaid,neutral,6
medicaid,positive,11
medicare,negative,4
medicare,neutral,25
medicare,positive,13
nra,negative,34
nra,neutral,264
nra,positive,99
obamacare,neutral,123
obamacare,positive,4
shooting,negative,51
shooting,neutral,459
shooting,positive,168
thewall,negative,2
thewall,neutral,9
thewall,positive,6
travelban,negative,9
travelban,neutral,72
travelban,positive,18
"""

# Hashtag, tone, mean score, mean sentiment, total.
TONE_MEANS = """\
daca,Joy,0.64186,1.0,1
guncontrol,Analytical,0.6916138000000001,0.2,5
guncontrol,Anger,0.5926965,0.0,2
guncontrol,Confident,0.8482246666666666,1.0,9
guncontrol,Joy,0.6039622,0.6,5
guncontrol,Sadness,0.7506547499999999,-0.5,4
guncontrol,Tentative,0.99856,-1.0,1
gunsense,Analytical,0.7045926666666666,0.3333333333333333,3
gunsense,Anger,0.7408334999999999,0.5,2
gunsense,Confident,0.9195805,0.5,2
gunsense,Fear,0.578497,0.0,1
gunsense,Joy,0.606156,1.0,2
gunsense,Sadness,0.639609,0.0,1
gunsense,Tentative,0.8577975,0.0,2
healthcare,Analytical,0.8711131451355637,0.09728867623604466,627
healthcare,Anger,0.8238892,-0.6,5
healthcare,Confident,0.8558616249999997,0.5454545454545454,88
healthcare,Fear,0.6511001111111112,0.1111111111111111,9
healthcare,Joy,0.6804630089285718,0.71875,224
healthcare,Sadness,0.6154968139534882,0.011627906976744186,86
healthcare,Tentative,0.7847152411764698,0.5705882352941176,170
medicaid,Analytical,0.879695,1.0,1
medicaid,Joy,0.547562,1.0,1
medicare,Sadness,0.586527,0.0,1
nra,Analytical,0.7265312500000001,0.375,8
nra,Confident,0.7572539999999999,1.0,4
nra,Fear,0.526302,1.0,1
nra,Joy,0.78754925,1.0,4
nra,Tentative,0.9069255,1.0,2
obamacare,Analytical,0.773748,0.0,1
shooting,Analytical,0.6697473333333334,0.13333333333333333,15
shooting,Anger,0.7339771428571428,-0.2857142857142857,7
shooting,Confident,0.8508676666666667,0.6666666666666666,3
shooting,Fear,0.8301885714285715,0.0,7
shooting,Joy,0.6901371126760564,0.352112676056338,71
shooting,Sadness,0.679703,-0.6666666666666666,6
shooting,Tentative,0.9360558333333334,0.16666666666666666,18
thewall,Joy,0.791101,0.0,1
travelban,Analytical,0.8163813333333333,1.0,3
travelban,Joy,0.594493,-1.0,1
travelban,Tentative,0.923096,1.0,3
"""
