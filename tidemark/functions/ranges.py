"""Ranges of indicators: what lies outside is kept, but marked."""

from __future__ import annotations

#: Indicator, smallest and largest value that is believed.
_TEXT = """
heartRates 25 350
restingHeartRates 25 220
walkingHeartRates 30 250
heartRateMax 25 350
heartRateMin 25 350
maxHeartRateProfile 25 350
dailyAvgHeartRate 25 250
dailyHeartRateAvg 25 250
dailyHeartRateMax 25 350
dailyHeartRateMin 25 250
dailyRestingHeartRates 25 180
dailyWalkingHeartRates 30 220
dailySleepAvgHeartRate 25 200
dailySleepBaseHeartRate 25 200
dailySleepLowestHeartRate 25 200
dailySleepMaxHeartRate 25 250
dailySleepMinHeartRate 25 200
oxygenSaturations 50 100
systolicPressures 40 280
diastolicPressures 20 200
bodyTemperatures 25 45
skinTemperature 15 45
wristTemperatures 15 45
temperatureDelta -5 5
respiratoryRates 4 80
dailyRespiratoryRates 4 60
dailyBaseRespiratoryRates 4 60
dailyMaxRespiratoryRates 4 80
dailyMinRespiratoryRates 4 60
dailySleepRespiratoryRate 4 40
dailySleepSkinTemperature 20 42
dailySleepTemperatureDelta -5 5
dailyFastRespiratoryDuration 0 86400000
dailySlowRespiratoryDuration 0 86400000
dailySleepFastHeartRateDuration 0 86400000
dailySleepSlowHeartRateDuration 0 86400000
bodyMasss 2 300
heights 0.3 2.5
bmis 10 80
bodyFatPercentages 2 70
bodyMuscle 20 70
bodyWater 30 80
bodyBone 1 8
bodyVisFat 1 50
bodySubFat 5 60
bodyProtein 5 30
basalMetabolicRate 800 4000
bodyFatFreeWeight 2 200
waistCircumferences 0.3 2
dailyWeight 2 300
exerciseMinutes 0 1440
steps 0 100000
floors 0 500
activeCalories 0 15000
basalCalories 0 3000
walkingRunningDistances 0 200000
cyclingDistances 0 500000
walkingSpeeds 0 13
cyclingSpeeds 0 40
speeds 0 40
stepDuration 0 86400000
walkingRunningDuration 0 86400000
cyclingDuration 0 86400000
floorsDuration 0 86400000
dailySteps 0 100000
dailyDistance 0 200000
dailyFloors 0 500
dailyCaloriesActive 0 15000
dailyCaloriesBasal 0 3000
dailyTotalCalories 0 20000
sedentaryTime 0 1440
restingTime 0 1440
dailyActivityIntensityHigh 0 1440
dailyActivityIntensityMedium 0 1440
dailyActivityIntensityLow 0 1440
bloodGlucoses 20 600
hrvDatas 5 500
hrvRMSSD 5 500
hrvMax 5 500
hrvMin 0 500
bodyCholesterol 1 20
bodyCholesterolHDL 0.3 8
bodyCholesterolLDL 0.3 15
bodyCholesterolTriglycerides 0.2 20
dailySleepAvgHrv 5 500
dailyWorkoutAvgHrv 5 500
sleepAnalysis_Awake 0 86400000
sleepAnalysis_Asleep(Deep) 0 86400000
sleepAnalysis_Asleep(Core) 0 86400000
sleepAnalysis_Asleep(REM) 0 86400000
sleepAnalysis_Asleep(Total) 0 86400000
sleepAnalysis_Asleep(Unspecified) 0 86400000
sleepAnalysis_InBed 0 86400000
napDuration 0 86400000
sleepDuration 0 24
totalSleepTime 0 86400
sleepLatency 0 43200
sleepEfficiency 5 100
sleepConsistency 0 100
sleepQuality 0 100
sleepPerformance 0 100
sleepOverallScore 0 100
sleepDisturbances 0 200
dailySleepEfficiency 5 100
dailyDeepSleepPercentage 0 100
dailyLightSleepPercentage 0 100
dailyRemSleepPercentage 0 100
dailyAwakeDurationPercentage 0 100
dailySleepContinuity 0 1
dailySleepSffcy 0 1
dailyAwakeTimes 0 200
dailySleepCycleTimes 0 30
stressLevel 0 100
recoveryScore 0 100
workoutDuration 0 1440
workoutDurationHigh 0 1440
workoutDurationLow 0 1440
workoutDurationMedium 0 1440
altitudeGain 0 15000
altitudeChange -15000 15000
"""

#: Indicator to its bounds as text.
BOUNDS = {name: (low, high) for name, low, high in (line.split() for line in _TEXT.split("\n") if line)}
#: Indicator to its rules, all of which must hold.
RANGES = {name: f">={low},<={high}" for name, (low, high) in BOUNDS.items()}
